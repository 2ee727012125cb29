"""Connected components as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of the nodes that have an edge to another node;
    component is the smallest node reachable. Rows with a null end and loops
    are ignored; no edges give an empty table.

    Large star and small star in turn until nothing changes: every node hangs
    its larger neighbours, then all its smaller ones, under the smallest. The
    edges never grow in number, minima are pre-aggregated, and the join back
    to a hub's edges is a plain join that Spark may split."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
    now = now.filter("x <> y").select("u", "v").distinct()
    mark = None
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        # A node's smallest neighbour holds for its own edge as well.
        large = large.union(low.filter("m < x").select("x", "m"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        now = cut_lineage(small.union(low).distinct())
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = new
