"""Pipeline API and sinks: invariants of a full run on the smallest tables."""

import glob
import tempfile

from pyspark.sql import functions as F

from lexaudit.plans import queries as Q
from lexaudit.plans.pipeline import rerun_analysis
from lexaudit.settings import Settings
from lexaudit.sources.sinks import crawl_tables, write_csv

SF = "/root/testdata/sf0.001"


def test_run_invariants(spark):
    run = Q._pipeline(spark, SF)
    s = run.summary.collect()[0]
    # targets + skipped = input; success + error + blocked = audited pages
    assert s["target_urls"] + s["skipped_urls"] == s["input_urls"]
    assert s["crawl_success"] + s["crawl_errors"] + s["robots_blocked"] == s["audited_pages"]
    assert s["final_total_tokens"] <= s["raw_total_tokens"]
    ranks = [r["rank"] for r in run.keyword_frequency.orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1))
    tables = crawl_tables(run.fetched_pages)
    assert sum(t.count() for t in tables.values()) == s["audited_pages"]


def test_rerun_keeps_inclusion(spark):
    run = Q._pipeline(spark, SF)
    again = rerun_analysis(run.text_audit, Settings(user_stopwords=("de",)))
    s = again.summary.collect()[0]
    assert s["execution_mode"] == "cached_text"
    assert again.keyword_frequency.filter(F.col("keyword") == "de").count() == 0


def test_csv_sink_has_bom(spark):
    out = tempfile.mkdtemp(prefix="lexaudit-sink-", dir="/tmp") + "/kw"
    df = spark.createDataFrame([(1, "a", 2)], "rank long, keyword string, freq long")
    write_csv(df.coalesce(1), out, "keyword_frequency")
    part = glob.glob(out + "/part-*.csv")[0]
    raw = open(part, "rb").read()
    assert raw.startswith("﻿順位,キーワード,出現数".encode("utf-8"))
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 1


def test_forced_phrases_and_taggers_reach_the_jobs(spark):
    from lexaudit import schemas
    from lexaudit.operators.tokens import script_tokens
    from lexaudit.plans.pipeline import rerun_analysis
    from lexaudit.settings import Settings
    names = [f.name for f in schemas.TEXT_AUDIT.fields]
    row = {"url": "http://a/", "included_in_analysis": True, "extracted_text": "東京タワー 東京タワー"}
    audit = spark.createDataFrame([tuple(row.get(n) for n in names)], schemas.TEXT_AUDIT)
    plain = Settings(compound_mode=False, use_default_stopwords=False)
    forced = plain.with_(forced_compounds=("東京タワー",))

    def keywords(settings, **more):
        return {r["keyword"]: r["freq"] for r in rerun_analysis(audit, settings, **more).keyword_frequency.collect()}

    assert keywords(plain) == {"東京": 2, "タワー": 2}
    assert keywords(forced) == {"東京タワー": 2}
    assert keywords(plain, tagger=script_tokens) == keywords(plain)


def test_prefetched_pages_that_are_no_target_are_left_out(spark):
    from lexaudit.operators.fetchlog import crawl_join
    from lexaudit.sources.readers import page_archive
    pages = page_archive(spark.createDataFrame([("http://a/1", "x"), ("http://a/2", "y")], "url string, html string"))
    targets = spark.createDataFrame([("http://a/1",)], "target_url string")
    out = crawl_join(targets, pages, None, pages)
    assert [r["target_url"] for r in out.collect()] == ["http://a/1"]
