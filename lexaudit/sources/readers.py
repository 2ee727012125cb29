"""Sources (SRC1-SRC10): every input is a table; order is carried as an
explicit position column from the source on."""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit import schemas
from lexaudit.functions.urls import py_strip


def read_table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A driver table (``{sf_dir}/{name}.parquet``), spread over the cores
    when the scan yields fewer splits than the cluster has task slots."""
    return spread_if_narrow(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")), key)


def spread_if_narrow(df: DataFrame, key: str | None = None) -> DataFrame:
    """A single large parquet row group is one task; CPU-heavy per-row work
    (regex tokenising, HTML parsing) then runs on one core. Only in that case
    the rows are redistributed (by ``key`` when given, so that later windows
    on the same key need no second exchange). A scan with enough splits, as
    on a large archive, is left alone: no extra shuffle."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, key) if key else df.repartition(slots)


def url_column(df: DataFrame, column: str, pos_col: str | None = None,
               site_id: str | None = None) -> DataFrame:
    """SRC1: one URL column of a sheet-like table. The column must exist;
    NULL -> '' and strip. Blanks are kept (they become ``empty_value``).

    ``pos_col`` names an existing order column; without one the position is
    ``monotonically_increasing_id`` of the scan order, which is increasing in
    file order for a single read.
    """
    if column not in df.columns:
        raise ValueError(f"URL column {column!r} not found; columns: {df.columns}")
    pos = F.col(pos_col).cast("long") if pos_col else F.monotonically_increasing_id()
    site = F.col("site_id").cast("string") if site_id is None and "site_id" in df.columns else F.lit(site_id or "")
    return df.select(site.alias("site_id"), pos.alias("input_pos"),
                     py_strip(F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("original_url"))


def url_text(df: DataFrame, text_col: str = "text", site_col: str | None = None) -> DataFrame:
    """SRC2: URL list text, one URL per line; blank lines are dropped.
    Each text row is one list (its site id), position = line index."""
    site = F.col(site_col).cast("string") if site_col else F.lit("")
    lines = df.select(site.alias("site_id"),
                      F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\\r\\n|\\r|\\n|\\x{85}|\\x{2028}|\\x{2029}|\\x0b|\\x0c|\\x1c|\\x1d|\\x1e"))
                      .alias("input_pos", "line"))
    return (lines.select("site_id", F.col("input_pos").cast("long"),
                         py_strip(F.col("line")).alias("original_url"))
            .filter(F.col("original_url") != ""))


def url_values(spark: SparkSession, values: Sequence[str], site_id: str = "") -> DataFrame:
    """SRC2 for an inline URL array (a settings value)."""
    rows = [(site_id, i, str(v).strip()) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, schemas.URL_INPUT)
    return df.filter(F.col("original_url") != "")


def target_table_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: a target table re-read from CSV as strings (NULL -> ''); the URL
    of a row is the first non-empty of normalized_url, target_url, url; rows
    without a URL are dropped."""
    df = spark.read.option("header", True).csv(path)
    df = df.na.fill("")
    cands = [F.when(F.col(c) != "", F.col(c)) for c in ("normalized_url", "target_url", "url") if c in df.columns]
    url = F.coalesce(*cands) if cands else F.lit(None).cast("string")
    return df.withColumn("url", url).filter(F.col("url").isNotNull())


def stopword_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: stopword file as a one-column table (strip, skip blank and '#'
    lines); normalisation happens in the keyword stage."""
    from lexaudit.functions.text import normalize_token_udf
    lines = spark.read.text(path).select(py_strip(F.col("value")).alias("w"))
    lines = lines.filter((F.col("w") != "") & ~F.col("w").startswith("#"))
    return lines.select(normalize_token_udf(F.col("w")).alias("keyword")).filter(F.col("keyword") != "").distinct()


def page_archive(pages: DataFrame) -> DataFrame:
    """SRC6 adapter: ``(page_id, url, html)`` -> ``fetched_pages`` rows with
    status 200, ``text/html``, no headers, robots not checked."""
    return pages.select(
        F.col("url").alias("target_url"),
        F.col("url").alias("final_url"),
        F.lit(200).alias("status_code"),
        F.array().cast(schemas.HEADERS).alias("headers"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.lit(None).cast("string").alias("error_kind"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(False).alias("robots_checked"),
        F.lit(None).cast("boolean").alias("robots_allowed"),
        F.lit("robots_not_checked").alias("robots_decision"),
        F.lit(None).cast("string").alias("robots_url"),
        F.lit(None).cast("timestamp_ntz").alias("fetched_at"),
        F.lit(0.0).alias("elapsed_sec"),
        F.lit(False).alias("redirect_happened"),
        F.octet_length(F.coalesce(F.col("html"), F.lit(""))).cast("long").alias("content_length"),
    )


def fetched_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: a stored page archive in the ``fetched_pages`` schema."""
    return spark.read.schema(schemas.FETCHED_PAGES).parquet(path)


def text_audit(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: a stored ``text_audit`` table for a re-run from cached text."""
    return spark.read.schema(schemas.TEXT_AUDIT).parquet(path)
