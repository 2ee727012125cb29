"""Ranking invariants and partition-count independence."""

from pyspark.sql import functions as F

from lexaudit.operators import keywords as K
from lexaudit.settings import Settings

SF = "/root/testdata/sf0.001"


def _ranked(spark, parts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(parts)
    s = Settings()
    return K.rank_frequency(K.raw_frequency(K.count_occurrences(K.noun_occurrences(docs, "text")), s))


def test_rank_is_dense_and_ordered(spark):
    rows = _ranked(spark, 8).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    keys = [(-r["freq"], r["keyword"]) for r in rows]
    assert keys == sorted(keys)


def test_partition_count_independent(spark):
    a = {tuple(r) for r in _ranked(spark, 1).collect()}
    b = {tuple(r) for r in _ranked(spark, 8).collect()}
    assert a == b


def test_ranks_per_group(spark):
    df = spark.createDataFrame([("s1", "a", 3), ("s1", "b", 3), ("s1", "c", 1), ("s2", "z", 5)],
                               "site_id string, keyword string, freq long")
    got = {(r["site_id"], r["keyword"]): r["rank"] for r in K.rank_frequency(df, ["site_id"]).collect()}
    assert got == {("s1", "a"): 1, ("s1", "b"): 2, ("s1", "c"): 3, ("s2", "z"): 1}


def test_terms_text_parsing():
    assert K.setting_terms("Foo, bar、ＢＡＺ，foo\r\n qux ") == ["foo", "bar", "baz", "qux"]
