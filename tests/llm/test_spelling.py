"""op12: against a plain version over all pairs and all runs."""

import random
import re
import zlib
from collections import Counter

import pytest

from lexaudit.llm import spelling
from lexaudit.llm.spelling import BUCKETS, near_words, pivots_of, prefix_of, runs, variants, word_counts
from tests_llm_support import SF, lower


def plain_words(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    return a[k + 1:] == b[k + 1:] or a[k:] == b[k + 1:] or a[k + 1:] == b[k:]


def plain_variants(count):
    by_size = {}
    for w in count:
        by_size.setdefault(len(w), []).append(w)
    around = {w: [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, ()) if near(w, v)] for w in count}
    form = {}
    for w in count:
        best = min(((-count[v], v) for v in around[w]), default=(0, None))
        form[w] = best[1] if -best[0] >= 2 * count[w] else None
    out = set()
    for w in count:
        end = w
        while form[end]:
            end = form[end]
        out.add((w, form[w], end, count[w], len(around[w]), count.get(form[w])))
    return out


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_words_of_documents_and_edge_cases(spark, edge, empty):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), edge):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert {r.word: r.n for r in word_counts(runs(df)).collect()} == plain_words(rows)
    assert variants(word_counts(runs(empty))).count() == 0


def test_deleted_code_points(spark):
    rows = [(k, f"Straße{k % 7} fiancée Émile élève {'x' * (k % 9)}yacht") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in word_counts(runs(df)).collect()}
    assert got == plain_words(rows)
    assert any(w not in ("straße", "fiancée", "émile", "élève") and "x" not in w and "y" not in w for w in got), got


def test_variants_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    words = word_counts(runs(df))
    assert rows_of(variants(words)) == plain_variants({r.word: r.n for r in words.collect()})


@pytest.mark.parametrize("letters,sizes", [("ab", (5, 9)), ("aé", (5, 6)), ("abcdefgh", (5, 7))])
def test_near_words_of_random_words(spark, letters, sizes):
    rnd = random.Random(5)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(*sizes))) for _ in range(250)}
    for w in list(words)[:80]:
        k = rnd.randrange(len(w))
        words |= {w[:k] + rnd.choice(letters) + w[k + 1:], w[:k] + rnd.choice(letters) + w[k:], w + "a", "b" + w}
    count = {w: rnd.choice((3, 3, 4, 6, 8, 16, 40)) for w in words if len(w) >= 5}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    assert rows_of(variants(df)) == plain_variants(count)
    pairs = near_words(df).collect()
    assert len(pairs) == len({(r.word, r.near) for r in pairs}) == 2 * sum(near(a, b) for a in count for b in count if a < b)


def test_chains_ties_and_long_words(spark):
    rows = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("abbbb", 48), ("bbbbb", 96), ("zzzzz", 3), ("zzzzy", 9),
            ("zzzzx", 9), ("x" * 3000, 3), ("x" * 3001, 7)]
    df = spark.createDataFrame(rows, "word string, n long")
    got = {r.word: r for r in variants(df).collect()}
    assert got["aaaaa"].root == "bbbbb" and got["aaaaa"].form == "aaaab" and got["bbbbb"].form is None
    assert got["zzzzz"].form == "zzzzx" and got["zzzzz"].n_near == 2
    assert got["x" * 3000].form_n == 7 and got["x" * 3001].root == "x" * 3001


def test_pivots_are_disjoint_and_least():
    rnd = random.Random(6)
    for _ in range(300):
        counts = [rnd.randrange(50) for _ in range(BUCKETS)]
        prefix, last = prefix_of("".join(rnd.choice("abc") for _ in range(rnd.randint(4, 12))), counts)
        a, b = pivots_of(prefix)
        weight = {p: o >> 32 for p, o in prefix}
        assert b - a >= 2 and len(prefix) >= spelling.PREFIX and max(o for _, o in prefix) == last
        assert weight[a] + weight[b] == min(weight[p] + weight[q] for p in weight for q in weight if q - p >= 2)
