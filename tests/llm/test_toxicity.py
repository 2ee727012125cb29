"""op1: held-out accuracy, unseen misspellings, no leak of the label."""

import zlib

import numpy as np
from lexaudit.llm import toxicity as tox
from pyspark.sql import functions as F
from tests_llm_support import SF


def corpus(n, seed):
    """Random prose; every fifth text has a few insults."""
    rnd = np.random.default_rng(seed)
    syllables = "ta ri mo ken lu sha per dol vin gra".split()
    out = []
    for i in range(n):
        ws = ["".join(rnd.choice(syllables, rnd.integers(1, 4))) for _ in range(rnd.integers(30, 120))]
        bad = i % 5 == 0
        for w in rnd.choice(["stupid", "moron", "idiot", "worthless"], 4) if bad else ():
            ws.insert(rnd.integers(0, len(ws)), w)
        out.append((" ".join(ws), int(bad)))
    return out


def test_held_out_accuracy_and_misspellings():
    train, test = corpus(500, 1), corpus(200, 2)
    scorer = tox.Scorer(*tox.train([t for t, _ in train], [y for _, y in train]))
    right = [(scorer.text(t) >= 0.5) == bool(y) for t, y in test]
    assert np.mean(right) >= 0.9
    clean = [t for t, y in test if not y][:60]
    plain = np.array([scorer.text(t) for t in clean])
    # Spellings that no training text has.
    spoilt = np.array([scorer.text(f"stupidd {t} worthles mooron") for t in clean])
    assert np.mean(spoilt > plain) >= 0.95


def test_query_contract_and_learning_rows(spark):
    rows = {r.doc_id: r for r in tox.op1_toxicity(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_labels_of_held_out_rows_are_not_used(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    a = tox.op1_toxicity(spark, SF).select("doc_id", "score").collect()
    b = tox.op1_toxicity(spark, str(tmp_path)).select("doc_id", "score").collect()
    assert sorted(a) == sorted(b)


def test_edge_cases(spark, edge, empty):
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 1), (12, 0, 1), (14, 1, 0), (1, 1, 0), (None, 1, 1), (13, 1, None)],
                                   "doc_id long, quality int, toxic int")
    model = tox.fit(edge, labels)
    rows = tox.score(edge, model, keep=("score", "row")).toDF("doc_id", "score", "kept_score", "row").collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 and r.kept_score == 0.5 for r in rows)
    blank = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1
    kept = tox.passed(edge, model)
    assert kept.columns == edge.columns and kept.count() == sum(r.score < 0.5 for r in rows)
    assert tox.score(empty, model).count() == 0
    nothing = tox.fit(edge, labels.limit(0))
    assert {r.score for r in tox.score(edge, nothing).collect()} == {0.5}
    only_clean = tox.fit(edge, labels.filter("toxic = 0 and doc_id <> 7"))
    assert max(r.score for r in tox.score(edge, only_clean).collect()) < 0.5
