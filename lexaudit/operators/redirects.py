"""Redirects of stored responses (DSC8): the URL after redirects, found by
pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.functions.urls import with_resolved_url
from lexaudit.session import written

# Redirect statuses, and redirects followed at most.
REDIRECT_STATUS = (301, 302, 303, 307, 308)
MAX_REDIRECTS = 30


def final_urls(steps: DataFrame, most: int = MAX_REDIRECTS) -> DataFrame:
    """``(url, final_url, hops)`` from ``(url, target)``.

    Each round joins every row with the row of its target and so doubles the
    steps taken: five joins for thirty redirects, whatever the chains look
    like. A row that is not at its end after ``most`` steps is in a loop, or in
    a chain that is too long: ``final_url`` is NULL. Of several targets of a
    URL the smallest counts."""
    jumps = steps.filter(F.col("url").isNotNull() & F.col("target").isNotNull()).groupBy("url").agg(
        F.min("target").alias("target"))
    jumps = written(jumps.withColumn("hops", F.lit(1)))
    for _ in range(most.bit_length()):
        ahead = jumps.select(F.col("url").alias("target"), F.col("target").alias("_to"), F.col("hops").alias("_more"))
        jumps = written(jumps.join(ahead, "target", "left").select(
            "url", F.coalesce("_to", "target").alias("target"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops")))
    return jumps.select("url", F.when(F.col("hops") <= most, F.col("target")).alias("final_url"), "hops")


def follow_redirects(docs: DataFrame, most: int = MAX_REDIRECTS) -> DataFrame:
    """``(sitemap_url, final_url, status_code, body)`` from ``(sitemap_url,
    status_code, location, body)``: the response at the end of each URL's
    redirects. A loop, too many redirects, or an end without a stored response
    has a NULL status (request failed); its ``final_url`` is the URL itself."""
    is_step = F.col("status_code").isin(*REDIRECT_STATUS) & (F.coalesce(F.col("location"), F.lit("")) != "")
    steps = with_resolved_url(docs.filter(is_step).select("sitemap_url", "location"), "sitemap_url", "location", "_target")
    ends = final_urls(steps.select(F.col("sitemap_url").alias("url"), F.nullif("_target", F.lit("")).alias("target")), most)
    direct = docs.filter(~F.coalesce(is_step, F.lit(False))).select(
        "sitemap_url", F.col("sitemap_url").alias("final_url"), "status_code", "body")
    found = direct.select("final_url", "status_code", "body")
    moved = docs.filter(is_step).select("sitemap_url").join(
        ends.select(F.col("url").alias("sitemap_url"), "final_url"), "sitemap_url", "left").join(found, "final_url", "left")
    known = F.col("status_code").isNotNull()
    return direct.unionByName(moved.select(
        "sitemap_url", F.when(known, F.col("final_url")).otherwise(F.col("sitemap_url")).alias("final_url"),
        "status_code", "body"))
