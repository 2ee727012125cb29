"""The stages one by one on their own inputs, and run()."""

import corpus_pipeline
import __spark_entry__ as entry
from lexaudit.llm.queries import QUERIES
from tests_llm_support import SF, words


def test_registered_queries():
    names = [n.split("_")[0] for n in QUERIES]
    assert names == [f"op{k}" for k in range(1, len(QUERIES) + 1)]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "suffix_dedup", "mixing", "bpe"]


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        ids, was = {r.doc_id for r in out.select("doc_id").collect()}, {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= was
        if name != "bpe":
            assert out.columns == columns
        if name in ("toxicity", "ngram_join"):
            assert len(ids) >= 0.8 * len(was)
        if name == "suffix_dedup":
            assert sum(len(r.text) for r in out.collect()) <= sum(len(r.text) for r in docs.collect())
        if name == "mixing":
            size = sum(len(words(r.text)) for r in docs.collect())
            assert abs(sum(len(words(r.text)) for r in out.collect()) - 1.5 * size) <= 25
        docs, before = out, name
    assert before == "bpe"
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


def test_stages_take_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
