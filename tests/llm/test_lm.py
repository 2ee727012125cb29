"""op10: the base against plain counts; the tree is a distribution, learns
from the training rows alone and beats shorter contexts."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from lexaudit.llm import lm
from lexaudit.llm.text import id_remainder
from pyspark.sql import functions as F
from tests_llm_support import SF, lower, words


def toks(text):
    return [*words(lower(text)), None]


def check_base(df, rows):
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    counts = Counter(w for i, t in docs if train(i) for w in toks(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((i or 0, not train(i), len(toks(t)), sum(counts[w] > 0 for w in toks(t)),
                   sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t))) for i, t in docs)
    got = sorted((r.doc_id or 0, not r.is_training, r.n_tokens, r.n_known, r.base_score) for r in rows)
    assert [w[:4] for w in want] == [g[:4] for g in got]
    assert np.allclose([w[4] for w in want], [g[4] for g in got], rtol=1e-9)
    assert {r.train_tokens for r in rows} == {n}


def test_base_and_tree_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lm.score_documents(docs, lambda: id_remainder() != 1).collect()
    check_base(docs, rows)
    assert all(r.score < 0 for r in rows)
    held = {r.doc_id: r.held_out for r in lm.op10_lm_scoring(spark, SF).collect()}
    assert held == {r.doc_id: not r.is_training for r in rows} and any(held.values())
    # Better than any byte being as likely as any other.
    sizes = {r.doc_id: len(" ".join(toks(r.text)[:-1]).encode()) + 1 for r in docs.collect()}
    assert sum(r.score for r in rows if not r.is_training) > -0.5 * math.log10(256) * sum(sizes[i] for i, h in held.items() if h)


def test_edge_cases(spark, edge, empty):
    rows = lm.score_documents(edge, lambda: id_remainder() != 1).collect()
    check_base(edge, rows)
    assert lm.score_documents(empty, lambda: id_remainder() != 1).count() == 0
    nothing = lm.score_documents(edge.filter("doc_id = 6"), lambda: F.lit(False)).first()
    # The nine bytes of "a b c d e" and the end, uniform over 256.
    assert abs(nothing.score + math.log10(256) * 10) < 1e-9 and nothing.train_tokens == 0


def test_probabilities_add_up_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tree = lm.learn(docs)
    assert len(tree.levels[0][0]) == 1 and len(tree.levels[3][0]) > 10
    keys, _ = lm.grams([lm.tokens(r.text) for r in docs.limit(3).collect()])
    for context in keys[:: max(1, len(keys) // 25)] >> 8:
        every = (int(context) << 8) | np.arange(256)
        assert abs((10 ** tree.log10(every)).sum() - 1) < 1e-9


def test_longer_contexts_help_and_equal_a_plain_lookup(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tree = lm.learn(docs)
    keys, sizes = lm.grams([lm.tokens(r.text) for r in docs.collect()])
    whole = tree.log10(keys)
    assert whole.sum() > tree.log10(keys, 1).sum() > tree.log10(keys, 0).sum()
    for key, value in list(zip(keys.tolist(), whole))[::997]:
        plain, at = 0.0, lm.DEPTH
        while at >= 0:
            contexts, back, entries, prob = tree.levels[at]
            place = np.flatnonzero(contexts == key >> (8 * (lm.DEPTH + 1 - at)))
            if len(place):
                entry = np.flatnonzero(entries == (place[0] << 8 | key & 255))
                plain += prob[entry[0]] if len(entry) else back[place[0]]
                if len(entry):
                    break
            at -= 1
        assert abs((plain if at >= 0 else plain - math.log10(256)) - value) < 1e-9


def test_held_out_text_does_not_teach(spark):
    docs = spark.createDataFrame([(i, f"common words of text number {i % 7}") for i in range(40)], "doc_id long, text string")
    changed = docs.withColumn("text", F.when(id_remainder() == 1, F.lit("quite other words")).otherwise(F.col("text")))
    a, b = ({r.doc_id: r.score for r in lm.score_documents(d, lambda: id_remainder() != 1).collect() if r.is_training} for d in (docs, changed))
    assert a == b


def test_a_larger_corpus_teaches_rare_contexts(spark):
    # Eight times each in over a million symbols; only six bytes tell the last.
    docs = spark.createDataFrame([(i, "common words of a text " * 2000 + ("qbcdefx zbcdefy" if i < 8 else "")) for i in range(30)],
                                 "doc_id long, text string")
    contexts = lm.learn(docs).levels[6][0]
    assert {int.from_bytes(w[::-1], "big") for w in (b"qbcdef", b"zbcdef")} <= set(contexts.tolist())


def test_scores_by_parts_equal_the_tree_in_memory(spark, edge, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 50_000)
    monkeypatch.setattr(lm, "STRETCH_BYTES", 120_000)
    monkeypatch.setattr(lm, "PART_BYTES", 100_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(edge.select("doc_id", "text"))
    rows = lm.score_documents(docs, lambda: id_remainder() != 1).collect()
    tree = lm.learn(docs.filter(F.coalesce(id_remainder() != 1, F.lit(True))))
    keys, sizes = lm.grams([lm.tokens(r.text) for r in docs.collect()])
    each = np.add.reduceat(tree.log10(keys), np.cumsum(sizes) - sizes)
    want = sorted((r.doc_id or 0, x) for r, x in zip(docs.collect(), each))
    got = sorted((r.doc_id or 0, r.score) for r in rows)
    assert [w[0] for w in want] == [g[0] for g in got]
    assert np.allclose([w[1] for w in want], [g[1] for g in got], rtol=1e-9)


def test_sums_of_sorted_pieces():
    rnd = np.random.default_rng(8)
    for n in (0, 1, 2, 17):
        sums, want = lm.Sums(), {}
        for _ in range(n):
            keys, counts = np.unique(rnd.integers(0, 500, int(rnd.integers(0, 300))), return_counts=True)
            sums.add(keys, counts)
            for k, c in zip(keys.tolist(), counts.tolist()):
                want[k] = want.get(k, 0) + c
        keys, counts = sums.take()
        assert dict(zip(keys.tolist(), counts.tolist())) == want and keys.tolist() == sorted(want)
        assert not sums.pieces


def test_postings_hold_the_words_of_a_small_piece_as_objects():
    rnd = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, 3000, 2000)) for _ in range(400)] + [None, "", "w1"]
    keys = [i * 5 + (1 << 33) for i in range(len(texts))]
    size = sum(len(t or "") for t in texts)
    batches = [pa.table({"row": keys, "text": texts}).to_batches()[0]]
    tracemalloc.start()
    got = list(lm.met_words(iter(batches), size + 1))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10 * size   # all words as objects: over 11 bytes for each of a text
    assert [b.num_rows for b in got] == [3000]
    for some in (got, list(lm.met_words(iter(batches), size // 3))):
        seen = Counter()
        for r in (r for b in some for r in b.to_pylist()):
            for at, n in zip(r["at"][::2], r["at"][1::2]):
                seen[r["word"], r["first"] + at] += n
        assert seen == Counter((w.encode(), k) for k, t in zip(keys, texts) for w in (t or "").split())


def test_words_are_counted_by_part_and_come_back_in_order():
    rnd = random.Random(3)
    want, rows = Counter(), []
    for chunk in range(5):
        seen = Counter(f"w{rnd.randrange(400)}é".encode() for _ in range(300))
        seen.update({b"only held out": 0, "\u0085x".encode(): 2})
        want.update(seen)
        rows += [(g, chunk, lm.pack_words(ws), lm.pack(np.array([seen[w] for w in ws])), ws) for g, ws in lm.dealt_words(seen, 3)]
        assert sorted(w for r in rows if r[1] == chunk for w in r[4]) == sorted(seen)
    occurrences = distinct = 0
    for part in range(3):
        mine = [r for r in rows if r[0] == part]
        out = lm.count_words(pa.table({"part": [r[0] for r in mine], "chunk": [r[1] for r in mine], "grams": [r[2] for r in mine],
                                       "data": [r[3] for r in mine]})).to_pylist()
        assert [lm.unpack(r["data"]).tolist() for r in out] == [[want[w] for w in r[4]] for r in mine]
        occurrences, distinct = occurrences + sum(r["n"] for r in out), distinct + sum(r["v"] for r in out)
    assert (occurrences, distinct) == (sum(want.values()), sum(c > 0 for c in want.values()))


def test_messages_are_smaller_than_half_the_words(spark, monkeypatch):
    """What a text's words take between the tasks: distinct words of a stretch,
    not a row for each word of each stretch."""
    monkeypatch.setattr(lm, "STRETCH_BYTES", 400_000)
    rnd = random.Random(4)
    texts = [" ".join(f"word{rnd.randrange(20_000)}" for _ in range(400)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    told = lm.score_documents(docs, lambda: id_remainder() != 1)
    check_base(docs, told.collect())
    sent = [lm.pack_words(ws) for _, ws in lm.dealt_words({w for t in texts for w in lm.tokens(t)}, 4)]
    assert sum(map(len, sent)) < sum(len(t) for t in texts) / 2
