"""Shared helpers: size-checked broadcast, ordered row numbers without a
single-partition window, literal-set filters."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.session import cut_lineage

# A side is broadcast only when its row count is known to be below this.
BROADCAST_ROW_LIMIT = 2_000_000
# Up to this many literals a membership test is an in-plan hash set (InSet);
# above it the values become a table and an anti/semi join.
INSET_LIMIT = 10_000


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` exchanged by ``keys`` into the session's number of partitions, at
    least one per task slot. With the number named Spark keeps it: by size
    alone it would join partitions of compact rows into a few long tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def maybe_broadcast(df: DataFrame, known_rows: int | None = None,
                    limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only behind a size check.

    ``known_rows`` is a proven bound when the caller has one (a settings list,
    a table keyed by partition id); otherwise the rows are counted.
    """
    rows = known_rows if known_rows is not None else df.count()
    return F.broadcast(df) if rows <= limit else df


def not_in_values(df: DataFrame, col: str, values: Iterable[str]) -> DataFrame:
    """Rows of ``df`` whose ``col`` is not in ``values`` (a driver-side
    settings list). Small lists stay a hash-set predicate; large ones become
    an anti join with a size-checked broadcast."""
    vals = sorted({v for v in values if v is not None})
    if not vals:
        return df
    if len(vals) <= INSET_LIMIT:
        return df.filter(~F.coalesce(F.col(col).isin(*vals), F.lit(False)))
    spark = df.sparkSession
    table = spark.createDataFrame([(v,) for v in vals], f"{col} string")
    return df.join(maybe_broadcast(table, known_rows=len(vals)), col, "left_anti")


def ordered_row_number(df: DataFrame, order: Sequence[Column], partition_cols: Sequence[str] = (),
                       out_col: str = "rank") -> DataFrame:
    """``row_number()`` over ``partitionBy(partition_cols).orderBy(order)``
    computed without sending any key to one task.

    The rows are range-partitioned and sorted by (keys, order), so a hot key
    spreads over many tasks. Inside each sorted partition the rows of one key
    are contiguous and ``monotonically_increasing_id`` numbers them
    consecutively; the rows of the same key in earlier partitions give the
    offset. The offsets table has at most (#partitions + #keys) rows. The
    sorted table is checkpointed first so that the partition layout is fixed
    even if a stage is recomputed after an executor loss.
    """
    keys = [F.col(c) for c in partition_cols]
    sorted_df = (df.orderBy(*keys, *order)
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id()))
    sorted_df = cut_lineage(sorted_df)
    counts = sorted_df.groupBy("_pid", *partition_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*partition_cols).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    offsets = offsets.select("_pid", *partition_cols, "_off", "_first")
    known = None if partition_cols else sorted_df.rdd.getNumPartitions()
    joined = sorted_df.join(maybe_broadcast(offsets, known_rows=known), ["_pid", *partition_cols])
    return joined.withColumn(out_col, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("long")) \
        .drop("_pid", "_mid", "_off", "_first")
