"""Driver contract: entry runs on sf0.001; every registered query builds
and has matching oracle keys."""

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["rank", "keyword", "freq"]
    assert df.count() > 0


def test_oracle_keys_subset():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_small_queries_run(spark):
    qs = entry.queries()
    for name in ("url_normalize", "robots_decisions", "fetch_outcome", "sitemap_status", "feed_status"):
        assert qs[name](spark, "/root/testdata/sf0.001").count() >= 0
