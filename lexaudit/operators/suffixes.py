"""Registered domains by a suffix table (URL12).

A rule is a domain suffix such as ``co.uk``; ``*.kawasaki.jp`` stands for any
label in front, and ``!city.kawasaki.jp`` takes a name out of such a rule.
The longest matching rule is the suffix of a host, an exception before all
others; the registered domain is the suffix and one label more.

The match is an equi-join: every host is exploded into its tails, which meet
the rules by their text. Hosts are reduced to distinct ones first, so the join
grows with the number of hosts, not of URLs, and neither the plan nor a
broadcast grows with the table beyond what Spark finds small enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.functions.urls import py_strip, registered_domain


def suffix_rules(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``(tail, more, exception)`` of the lines of a suffix file: comments
    (``//``) and blank lines are skipped, a line ends at white space, case and
    a leading dot do not count, repeated rules are one. ``more``: labels that
    the suffix has in front of ``tail`` (1 for a wildcard, -1 for an
    exception, else 0)."""
    line = F.lower(F.regexp_extract(F.coalesce(F.col(line_col), F.lit("")), "^\\s*(\\S*)", 1))
    rules = lines.select(line.alias("_r")).filter((F.col("_r") != "") & ~F.col("_r").startswith("//"))
    more = F.when(F.col("_r").startswith("!"), -1).when(F.col("_r").startswith("*."), 1).otherwise(0)
    rules = rules.select(F.regexp_replace("_r", "^(!|\\*\\.|\\.)", "").alias("tail"), more.alias("more"))
    return rules.filter("tail <> ''").distinct().withColumn("exception", F.col("more") == -1)


def with_registered_domain(df: DataFrame, host_col: str, out_col: str, rules: DataFrame | None = None) -> DataFrame:
    """``df`` with the registered domain of ``host_col``. A host that no rule
    matches, or that is a suffix itself, takes the fallback rule, as does
    every host where ``rules`` is not given; a null host gives ''."""
    fallback = registered_domain(F.col(host_col))
    if rules is None:
        return df.withColumn(out_col, fallback)
    clean = F.regexp_replace(py_strip(F.lower(F.coalesce(F.col(host_col), F.lit("")))), "\\.+$", "")
    hosts = df.select(clean.alias("_host")).filter("_host <> ''").distinct()
    labels = F.split("_host", "\\.")
    tails = hosts.select("_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".").alias("tail")))).alias("_t"))
    met = tails.select("_host", "_t.k", "_t.tail").join(rules, "tail")
    best = met.groupBy("_host").agg(F.max(F.struct("exception", (F.col("k") + F.col("more")).alias("size"))).alias("_best"))
    n = F.col("_best.size") + 1
    found = best.filter((n >= 2) & (n <= F.size(labels))).select(
        "_host", F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("_found"))
    out = df.withColumns({"_host": clean, "_fallback": fallback}).join(found, "_host", "left")
    return out.withColumn(out_col, F.coalesce("_found", "_fallback")).select(*df.columns, out_col)
