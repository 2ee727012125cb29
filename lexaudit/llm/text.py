"""Shared text rules and small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: str = "doc_id", mod: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def n_words(text: Column) -> Column:
    """Number of words (null text: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def blocks_of(total_bytes: int | None, per_block: int) -> int:
    return max(1, -(-int(total_bytes or 0) // per_block))
