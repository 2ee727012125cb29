"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 65,536 points. A row hashes
to a point by its id and belongs to the first virtual node clockwise (its
*home*). Shards have a capacity; rows that find their home shard full go on
clockwise to the next virtual node with room. Capacities add up to the number
of rows and differ by one at most, so the shards' row counts differ by one at
most; only the overflow of a shard moves away from home.

Spark does the row work: a narrow table (id, size, crc) is cut once, rows are
counted per (arc, cell) - an arc is the stretch of the ring before a virtual
node, a cell one of 256 hash classes in it - and ranked inside their cell.
What is decided outside of the row tables is only the flow between arcs,
whose number (shards x vnodes) is a parameter, never a function of the data.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaudit.session import cut_lineage

POINTS = 65_536
CELLS = 256
BLOCK = 10_000


def ring(spark: SparkSession, shards: int, vnodes: int, seed: int = 7) -> DataFrame:
    """(point, arc, home) for each of the 65,536 ring points. Where two virtual
    nodes hash to one point, the smaller shard keeps it."""
    nodes = (spark.range(shards * vnodes)
             .select((F.col("id") / vnodes).cast("int").alias("home"), "id")
             .withColumn("point", F.pmod(F.xxhash64("home", F.col("id") % vnodes, F.lit(seed)), F.lit(POINTS)))
             .groupBy("point").agg(F.min("home").alias("home")))
    onward = Window.orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("home").isNotNull(), F.struct(F.col("point").alias("arc"), "home"))
    every = spark.range(POINTS).select(F.col("id").alias("point")).join(nodes, "point", "left")
    around = every.select("point", F.last(at, ignorenulls=True).over(onward).alias("n"))
    first = nodes.agg(F.min_by(F.struct(F.col("point").alias("arc"), "home"), "point").alias("first"))
    return around.join(F.broadcast(first)).select(
        "point", F.coalesce("n", "first").alias("n")).select("point", "n.arc", "n.home")


def flow(arcs: list[tuple[int, int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Intervals (arc, lo, hi, shard, slot_base): the rows of ``arc`` ranked
    lo..hi-1 go to ``shard`` and fill its slots from ``slot_base`` on.

    ``arcs`` is (arc, home, rows) of the whole ring in order, arcs without
    rows included. Step 0 offers every arc to its home; what a full shard
    turns away is offered to the next arc's shard in step 1, and so on once
    around the ring. Homes come before guests. Capacities add up to the rows."""
    left, used = list(capacity), [0] * len(capacity)
    waiting = [(i, 0, n) for i, (_, _, n) in enumerate(arcs) if n]
    out = []

    def place(i: int, lo: int, hi: int, shard: int) -> int:
        take = min(left[shard], hi - lo)
        if take:
            out.append((arcs[i][0], lo, lo + take, shard, used[shard]))
            left[shard] -= take
            used[shard] += take
        return lo + take

    for step in range(len(arcs)):
        turned = [(i, place(i, lo, hi, arcs[(i + step) % len(arcs)][1]), hi) for i, lo, hi in waiting]
        waiting = [x for x in turned if x[1] < x[2]]
        if not waiting:
            break
    # A shard all of whose points went to others is on no arc.
    for i, lo, hi in waiting:
        for shard in range(len(capacity)):
            lo = place(i, lo, hi, shard)
    return out


def assign_shards(docs: DataFrame, shards: int, vnodes: int = 128, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, home_shard), one row per input row.

    size: UTF-8 bytes of the text (null: none) plus 1. text_crc32: unsigned
    crc32 of the UTF-8 text (null: as empty). slot: gapless from 0 in each
    shard. Other input columns are ignored, whatever their names. A null id
    hashes like any other id; repeated rows are separate rows, and rows equal
    in id, size and crc may swap slots. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(POINTS)).alias("point"))
    # Equal rows are one row with its number until they have their slots, so
    # repeated rows weigh nothing in windows and exchanges.
    points = ring(spark, shards, vnodes)
    rows = cut_lineage(narrow.join(F.broadcast(points), "point")
                       .withColumn("cell", F.pmod(F.xxhash64("text_crc32", "doc_id", "size"), F.lit(CELLS)))
                       .groupBy("arc", "home", "cell", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("times")))
    cells = rows.groupBy("arc", "home", "cell").agg(F.sum("times").alias("n"))
    # At most shards x vnodes rows.
    held = cells.groupBy("arc", "home").agg(F.sum("n").alias("n"))
    whole = points.select("arc", "home").distinct().join(held, ["arc", "home"], "left")
    arcs = [(r.arc, r.home, r.n or 0) for r in whole.orderBy("arc").collect()]
    total = sum(n for _, _, n in arcs)
    plan = flow(arcs, [total // shards + (s < total % shards) for s in range(shards)])
    by_arc: dict[int, list] = {}
    for arc, *interval in plan:
        by_arc.setdefault(arc, []).append(interval)
    # The plan as one JSON literal; it has shards x vnodes rows at most.
    text = json.dumps([{"arc": a, "intervals": [dict(zip(("lo", "hi", "shard", "base"), x)) for x in xs]}
                       for a, xs in by_arc.items()])
    kind = "array<struct<arc: bigint, intervals: array<struct<lo: bigint, hi: bigint, shard: int, base: bigint>>>>"
    intervals = spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))

    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("arc", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # One row per arc: shards x vnodes rows at most.
    starts = starts.join(F.broadcast(intervals), "arc")
    in_cell = Window.partitionBy("arc", "cell").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("first", F.coalesce(F.sum("times").over(in_cell), F.lit(0))).join(starts, ["arc", "cell"])
    ranked = ranked.withColumn("first", F.col("start") + F.col("first"))
    # A row that is repeated very often leaves its task in blocks.
    often = ranked.filter(F.col("times") > BLOCK).withColumn("skip", F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(BLOCK))))
    often = often.withColumn("first", F.col("first") + F.col("skip")).withColumn(
        "times", F.least(F.col("times") - F.col("skip"), F.lit(BLOCK))).drop("skip").repartition("first")
    ranked = ranked.filter(F.col("times") <= BLOCK).unionByName(often)
    ranked = ranked.withColumn("rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("times") - 1)))
    placed = ranked.withColumn("to", F.filter("intervals", lambda x: F.col("rank") < x["hi"])[0])
    return placed.select("doc_id", "size", "text_crc32", F.col("to.shard").alias("shard"),
                         (F.col("to.base") + F.col("rank") - F.col("to.lo")).cast("long").alias("slot"),
                         F.col("home").alias("home_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards whose row counts differ by one at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home_shard")
