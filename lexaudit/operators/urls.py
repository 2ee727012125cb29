"""URL list classification (URL6, URL8, URL9, URL10).

Order of tests: URL1 reason -> exclude pattern -> duplicate (first wins) ->
cap. A URL rejected by the cap never enters the "seen" set, so its later
copies are also ``max_urls_exceeded``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.functions.urls import first_matching_pattern, with_normalized_url
from lexaudit.operators.common import maybe_broadcast


def classify_urls(urls: DataFrame, *, exclude_patterns: Sequence[str] = (),
                  max_urls: int | None = None, exclude_pdf: bool = True,
                  source_type: str = "url_list") -> DataFrame:
    """URL10: one labelled table ``(site_id, input_pos, original_url,
    normalized_url, source_type, skip_reason)``; ``skip_reason`` is NULL for
    targets. Input: ``(site_id, input_pos, original_url)``.

    First-wins is ``min(input_pos)`` per (site, URL) -- a partial aggregate,
    so a URL repeated a billion times is combined map-side -- joined back
    (AQE splits a skewed join key). The cap takes the first N distinct URLs
    per site with ``row_number() <= N``, which Spark plans as a
    per-partition group limit before the shuffle; the accepted set is at most
    N rows per site and is broadcast behind a size check.
    """
    if "site_id" not in urls.columns:
        urls = urls.withColumn("site_id", F.lit(""))
    df = with_normalized_url(urls.select("site_id", "input_pos", "original_url"), "original_url",
                             exclude_pdf, "normalized_url", "_reason")
    pat = first_matching_pattern(F.col("normalized_url"), exclude_patterns)
    df = df.withColumn("_reason", F.coalesce(
        F.col("_reason"), F.when(pat.isNotNull(), F.concat(F.lit("exclude_pattern:"), pat))))
    # No filter on the derived reason before the join: Catalyst would push
    # it below the projections and inline the whole normaliser into it.
    firsts = df.groupBy("site_id", "normalized_url").agg(
        F.min(F.when(F.col("_reason").isNull(), F.col("input_pos"))).alias("_first_pos"))
    if max_urls is not None and int(max_urls) > 0:
        n = int(max_urls)
        w = Window.partitionBy("site_id").orderBy("_first_pos")
        accepted = (firsts.filter(F.col("_first_pos").isNotNull())
                    .withColumn("_rn", F.row_number().over(w))
                    .filter(F.col("_rn") <= n).drop("_rn"))
        labelled = df.join(maybe_broadcast(accepted), ["site_id", "normalized_url"], "left")
        reason = (F.when(F.col("_first_pos").isNull(), F.lit(f"max_urls_exceeded:{n}"))
                  .when(F.col("input_pos") != F.col("_first_pos"), F.lit("duplicate_url")))
    else:
        labelled = df.join(firsts, ["site_id", "normalized_url"], "left")
        reason = F.when(F.col("input_pos") != F.col("_first_pos"), F.lit("duplicate_url"))
    out = labelled.withColumn("_reason", F.coalesce(F.col("_reason"), reason))
    return out.select("site_id", "input_pos", "original_url", "normalized_url",
                      F.when(F.col("_reason").isNull(), F.lit(source_type)).alias("source_type"),
                      F.col("_reason").alias("skip_reason"))


def targets(classified: DataFrame) -> DataFrame:
    """SNK1 rows: accepted URLs."""
    return classified.filter(F.col("skip_reason").isNull()).select(
        "site_id", "input_pos", "original_url", "normalized_url", "source_type")


def skipped(classified: DataFrame) -> DataFrame:
    """SNK2 rows: rejected URLs with their reason."""
    return classified.filter(F.col("skip_reason").isNotNull()).select(
        "site_id", "input_pos", "original_url", "normalized_url", "skip_reason")
