"""Robots rules (ROB1-ROB5, ROB7) with the standard-library parser's
semantics, as table operations.

Bodies come in as ``(origin, robots_url, source_status, body)``, one row per
origin. Lines become rows; the parser's state machine becomes window
values over the line order (last user-agent/blank line seen, start of a new
group); the decision is an equi-join on origin plus a prefix predicate,
first matching rule by file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.functions.http import py_quote, py_unquote
from lexaudit.functions.urls import py_strip

LINE_BREAK_RE = "\\r\\n|\\r|\\n|\\x0b|\\x0c|\\x1c|\\x1d|\\x1e|\\x{85}|\\x{2028}|\\x{2029}"


def robots_policies(bodies: DataFrame) -> DataFrame:
    """ROB1: per origin, ``policy`` = allow_all (request failed, 404, other
    4xx/5xx), disallow_all (403) or parse."""
    st = F.col("source_status")
    policy = (F.when(st.isNull(), F.lit("allow_all"))
              .when(st == 404, F.lit("allow_all"))
              .when(st == 403, F.lit("disallow_all"))
              .when(st >= 400, F.lit("allow_all"))
              .otherwise(F.lit("parse")))
    return bodies.select("origin", "robots_url", "source_status", policy.alias("policy"), "body")


def robots_rules(bodies: DataFrame) -> DataFrame:
    """ROB2: rule table ``(origin, entry, agents, is_default, entry_rank,
    seq, allow, path)`` of the parsed bodies. ``entry_rank`` orders the
    non-default entries; the default entry is the first group naming '*'."""
    p = robots_policies(bodies).filter(F.col("policy") == "parse")
    lines = p.select("origin", F.posexplode(F.split(F.coalesce(F.col("body"), F.lit("")), LINE_BREAK_RE))
                     .alias("ln", "line"))
    content = py_strip(F.regexp_replace(F.col("line"), "#.*$", ""))
    has_colon = content.contains(":")
    key = F.lower(py_strip(F.regexp_extract(content, "^([^:]*):", 1)))
    value = py_unquote(py_strip(F.regexp_extract(content, "^[^:]*:(.*)$", 1)))
    kind = (F.when(F.col("line") == "", F.lit("blank"))
            .when(has_colon & (key == "user-agent"), F.lit("ua"))
            .when(has_colon & key.isin("allow", "disallow"), F.lit("rule"))
            .otherwise(F.lit("other")))
    t = lines.select("origin", "ln", kind.alias("kind"), key.alias("key"), value.alias("value"))
    w = Window.partitionBy("origin").orderBy("ln")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    prev_sig = F.last(F.when(F.col("kind") != "other", F.col("kind")), ignorenulls=True).over(before)
    last_ub = F.last(F.when(F.col("kind").isin("ua", "blank"), F.col("kind")), ignorenulls=True).over(before)
    t = t.select("*", prev_sig.alias("_prev_sig"), last_ub.alias("_last_ub"))
    start = (F.col("kind") == "ua") & (F.coalesce(F.col("_prev_sig"), F.lit("")) != "ua")
    t = t.withColumn("entry", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    active_rule = (F.col("kind") == "rule") & (F.col("_last_ub") == "ua")
    agents = t.filter(F.col("kind") == "ua").groupBy("origin", "entry").agg(
        F.array_sort(F.collect_list(F.struct("ln", "value")))["value"].alias("agents"))
    rules = t.filter(active_rule).select(
        "origin", "entry", F.col("ln").alias("seq"),
        # An empty Disallow means allow all.
        ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"),
        py_quote(F.col("value")).alias("path"))
    # Groups without rules are dropped (agents followed by a blank line).
    entries = agents.join(rules.select("origin", "entry").distinct(), ["origin", "entry"])
    entries = entries.withColumn("_star", F.array_contains("agents", "*"))
    we = Window.partitionBy("origin").orderBy("entry")
    first_star = F.min(F.when(F.col("_star"), F.col("entry"))).over(Window.partitionBy("origin"))
    entries = entries.withColumn("is_default", F.col("_star") & (F.col("entry") == first_star))
    entries = entries.filter(~F.col("_star") | F.col("is_default"))
    entries = entries.withColumn("entry_rank", F.row_number().over(we))
    return rules.join(entries.select("origin", "entry", "agents", "is_default", "entry_rank"),
                      ["origin", "entry"])


def robots_decisions(urls: DataFrame, bodies: DataFrame, user_agent: str,
                     url_col: str = "url") -> DataFrame:
    """ROB3-ROB5: per URL ``(url, origin, allowed, robots_decision,
    robots_url, source_status)``.

    Agent match: the lower-cased name before '/' of our user agent contains
    the entry's agent; the first matching non-default entry wins, else the
    default entry. Path match: the first rule in file order whose quoted
    path is a prefix of the quoted ``path;params?query#fragment``. The UA
    test is a constant per entry, so it is evaluated on the (small) rules
    table before the join."""
    ua = user_agent.split("/")[0].lower()
    u = urls.select(F.col(url_col).alias("url")).distinct()
    u = u.withColumn("_u", py_strip(F.col("url")))
    auth_re = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"
    u = u.withColumn("_scheme", F.lower(F.regexp_extract("_u", auth_re, 1))) \
        .withColumn("_netloc", F.regexp_extract("_u", auth_re, 2))
    u = u.withColumn("origin", F.when(F.col("_scheme").isin("http", "https") & (F.col("_netloc") != ""),
                                      F.concat("_scheme", F.lit("://"), "_netloc")))
    # The tested string: quote(path;params?query#fragment) of unquote(url).
    u = u.withColumn("_rest", un_after(py_unquote(F.col("_u"))))
    u = u.withColumn("_fname", py_quote(F.col("_rest")))
    u = u.withColumn("_fname", F.when(F.col("_fname") == "", F.lit("/")).otherwise(F.col("_fname")))
    u = u.select("url", "origin", "_fname")
    pol = robots_policies(bodies).select("origin", "robots_url", "source_status", "policy")
    rules = robots_rules(bodies)
    # Entry choice per origin does not depend on the URL.
    matches = rules.withColumn("_agent_hit", F.exists("agents", lambda a: F.lit(ua).contains(F.lower(a))))
    chosen = (matches.filter(~F.col("is_default") & F.col("_agent_hit"))
              .groupBy("origin").agg(F.min("entry_rank").alias("_rank")))
    default = matches.filter(F.col("is_default")).select("origin", F.col("entry_rank").alias("_def_rank")).distinct()
    pick = (pol.select("origin").join(chosen, "origin", "left").join(default, "origin", "left")
            .select("origin", F.coalesce("_rank", "_def_rank").alias("_use_rank")))
    active = rules.join(pick, "origin").filter(F.col("entry_rank") == F.col("_use_rank")) \
        .select("origin", "seq", "allow", "path")
    # One row per path, with its first place in the file: that one decides.
    active = active.groupBy("origin", "path").agg(F.min_by("allow", "seq").alias("allow"), F.min("seq").alias("seq"))
    lengths = active.groupBy("origin").agg(F.collect_set(F.length("path")).alias("_lengths"))
    d = u.join(pol.join(lengths, "origin", "left"), "origin", "left")
    # Only prefixes of a length that some rule of the origin has can be rules:
    # a URL meets its rules by equality, never the other rules of its origin.
    fits = F.filter("_lengths", lambda n: n <= F.length("_fname"))
    d = d.withColumn("path", F.explode_outer(F.transform(fits, lambda n: F.substring("_fname", F.lit(1), n))))
    d = d.join(active, ["origin", "path"], "left").groupBy("url", "origin", "policy", "robots_url", "source_status").agg(
        F.min_by("allow", "seq").alias("_rule_allow"))
    allowed = (F.when(F.col("origin").isNull(), F.lit(True))
               .when(F.col("policy").isNull(), F.lit(True))
               .when(F.col("policy") == "disallow_all", F.lit(False))
               .when(F.col("policy") == "allow_all", F.lit(True))
               .otherwise(F.coalesce(F.col("_rule_allow"), F.lit(True))))
    decision = (F.when(F.col("origin").isNull(), F.lit("robots_not_checked_invalid_url"))
                .when(allowed, F.lit("allowed_by_robots_txt")).otherwise(F.lit("blocked_by_robots_txt")))
    return d.select("url", "origin", allowed.alias("allowed"), decision.alias("robots_decision"),
                    "robots_url", "source_status")


def un_after(url):
    """Part after ``scheme://netloc`` (path, params, query, fragment)."""
    return F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?", "")
