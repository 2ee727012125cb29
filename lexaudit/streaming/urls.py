"""Streaming URL normalisation and page checks.

The per-row stages (URL1-URL5, URL11-URL13, FET5-FET7, EXT1, EXT4, EXT8-EXT12)
are plain column code and run unchanged on ``readStream``. Stages that need
order across rows (first-wins dedupe, caps, token windows, BFS) are batch;
on a stream they run per micro-batch inside ``foreachBatch``, where the
dedupe is made global by a left-anti join against the URLs already written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit import schemas
from lexaudit.functions.urls import registered_domain, url_host, url_origin, with_normalized_url


def normalized_url_stream(spark: SparkSession, source_dir: str, fmt: str = "parquet",
                          url_col: str = "url") -> DataFrame:
    """A streaming DataFrame of ``(url, normalized_url, skip_reason, origin,
    registered_domain)`` over files arriving in ``source_dir``."""
    schema = spark.read.format(fmt).load(source_dir).schema
    s = spark.readStream.format(fmt).schema(schema).load(source_dir)
    n = with_normalized_url(s.select(F.col(url_col).alias("url")), "url")
    return n.select("url", "normalized_url", "skip_reason", url_origin(F.col("url")).alias("origin"),
                    registered_domain(url_host(F.col("url"))).alias("registered_domain"))


def dedupe_batch_writer(target_path: str):
    """``foreachBatch`` function: append each micro-batch's new accepted URLs
    (first wins within the batch by input order; URLs already written are
    skipped by an anti join with the target table)."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        ok = batch.filter(F.col("skip_reason").isNull())
        firsts = ok.groupBy("normalized_url").agg(F.min_by("url", F.col("url")).alias("url"))
        try:
            seen = spark.read.parquet(target_path).select("normalized_url")
            firsts = firsts.join(seen, "normalized_url", "left_anti")
        except Exception:  # noqa: BLE001 - first batch, no table yet
            pass
        firsts.withColumn("epoch_id", F.lit(epoch_id)).write.mode("append").parquet(target_path)
    return write


URL_SCHEMA = schemas.URL_INPUT
