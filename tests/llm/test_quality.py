"""op5: counts against a plain version, the binomial tail, the thresholds."""

import math
from collections import Counter

from lexaudit.llm.quality import binomial_tail, cutoffs, judge, op5_quality, signals
from pyspark.sql import functions as F
from tests_llm_support import SF, words


def plain(text):
    w = words(text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def check(rows, texts):
    want = sorted((i if i is not None else -99, *plain(t)) for i, t in texts)
    got = sorted((r.doc_id if r.doc_id is not None else -99, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                 for r in rows)
    assert got == want


def test_counts_on_documents(spark):
    rows = op5_quality(spark, SF).collect()
    check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_counts_on_edge_cases(edge, empty):
    check(signals(edge).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    labels = edge.sparkSession.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    assert judge(edge, labels).count() == edge.count()
    assert judge(edge, labels.limit(0)).filter("not base_failed and not kept").count() == 0
    assert judge(empty, labels).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, 0.1), (3, 100, 0.1), (40, 1000, 0.05), (900, 100_000, 0.01), (7, 50, 0.1), (0, 100_000, 0.001)]
    for k, n, p in cases:
        got = spark.range(1).select(binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        want = 1.0 if k >= n * p else math.fsum(
            math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
            for i in range(k + 1))
        assert abs(got - want) <= 1e-7 * want


def test_thresholds_bound_false_rejections(spark):
    """Stratum a has junk-free good rows, b good rows that are symbols, c few."""
    rows = [(i, "a", 0) for i in range(4000)] + [(10_000 + i, "b", 30 * (i % 10 == 0)) for i in range(4000)] + [(20_000 + i, "c", 0) for i in range(20)]
    docs = spark.createDataFrame([(i, s, " ".join(["word"] * 30) + "#" * n) for i, s, n in rows], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in rows], "doc_id long, quality int")
    got = {r.stratum: r for r in cutoffs(signals(docs), labels).collect()}
    assert got["a"].max_symbols == 0.01 and got["c"].max_symbols is None
    assert got["b"].max_symbols >= 0.2
    kept = judge(docs, labels).filter("not base_failed and not kept")
    assert kept.count() == 0
    junk = spark.createDataFrame([(1, "a", "#$ " * 40), (2, "c", "#$ab " * 40)], "doc_id long, lang string, text string")
    assert junk.count() == 2


def test_same_verdict_for_any_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = judge(docs.coalesce(1), labels).select("doc_id", "kept").collect()
    many = judge(docs.repartition(7), labels).select("doc_id", "kept").collect()
    assert sorted(one) == sorted(many)
