"""op13: against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from lexaudit.llm import collocations as module
from lexaudit.llm.collocations import collocations, frequent_phrases
from tests_llm_support import SF, lower


def plain_counts(rows):
    count = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            count[lang, 0, ""] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    count[lang, k, " ".join(w[i:i + k])] += 1
    return count


def plain_frequent(rows, least=10):
    return {(*key, n) for key, n in plain_counts(rows).items() if n and (key[1] == 0 or n >= least)}


def plain_collocations(rows, top, least=10):
    count, best = plain_counts(rows), {}
    found = {key: a for key, a in count.items() if key[1] >= 2 and a >= least}
    for (lang, k, phrase), a in found.items():
        w = phrase.split(" ")
        l, r = lambda c: count[lang, c, " ".join(w[:c])], lambda c: count[lang, k - c, " ".join(w[c:])]
        score, c = min((10**6 * a * a // (l(c) * r(c)), c) for c in range(1, k))
        longer = max((b for (g, m, p), b in found.items() if m > k and g == lang and f" {phrase} " in f" {p} "), default=0)
        if 100 * longer < 50 * a:
            best.setdefault(lang, []).append((-score, -a, phrase.encode(), l(c), r(c)))
    return {(lang, i, p.decode(), -a, l, r, count[lang, 0, ""], -s) for lang, rows in best.items()
            for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def pairs(df):
    return [(r.text, r.lang) for r in df.collect()]


def test_documents_and_edge_cases(spark, edge, empty):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for df, least in ((documents, 10), (edge, 10), (edge, 2)):
        assert rows_of(frequent_phrases(df, least)) == plain_frequent(pairs(df), least)
        assert rows_of(collocations(df, 50, least)) == plain_collocations(pairs(df), 50, least)
    assert collocations(empty).count() == 0


def prose(rnd, n):
    words = ["new", "york", "city", "of", "the", "a", "é", "日本", "\x00x", "x y", "x\ty", "end.", "a,b", "line\nline", "Big", "big"]
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.mark.parametrize("chunk,bits,sample", [(8 << 20, 26, 8), (40, 26, 8), (300, 6, 2), (300, 7, 1), (300, 26, 10**6)])
def test_chunks_collisions_and_samples_change_nothing(spark, monkeypatch, chunk, bits, sample):
    """Small chunks; bit tables in which most bits collide; a sample that
    holds all documents, or none, so that the expansion does all the work."""
    for name, value in (("CHUNK", chunk), ("WORD_BITS", bits), ("PAIR_BITS", bits), ("SAMPLE", sample)):
        monkeypatch.setattr(module, name, value)
    rnd = random.Random(7)
    rows = [(k, prose(rnd, rnd.randint(0, 60)), rnd.choice(["en", "fr", None, ""])) for k in range(80)]
    rows += [(None, "of the city", "en")] * 9 + [(5, None, "en"), (6, "", None), (7, "w " * 500, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    assert rows_of(frequent_phrases(df)) == plain_frequent(pairs(df))
    assert rows_of(collocations(df, 12)) == plain_collocations(pairs(df), 12)


def test_a_third_of_all_words_is_one_phrase(spark):
    rows = [(k, "hot line " * 40 + f"w{k % 50} z{k % 3}", "en") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert rows_of(collocations(df)) == plain_collocations(pairs(df), 2000)


def test_scores_are_exact_above_64_bits(spark, monkeypatch):
    big = 3_000_000_000_001
    counts = [("en", 0, "", 9 * big), ("en", 1, "a", 2 * big), ("en", 1, "b", big + 7), ("en", 2, "a b", big)]
    df = spark.createDataFrame(counts, module._COUNTS)
    monkeypatch.setattr(module, "frequent_phrases", lambda *a, **k: df)
    (row,) = collocations(df).collect()
    assert row.score == 10**6 * big * big // (2 * big * (big + 7)) and (row.a, row.l, row.r, row.n) == (big, 2 * big, big + 7, 9 * big)
