"""Fetch outcome from a fetch-attempt log (FET1-FET11) and the crawl join
order (FET10).

Input contract ``fetch_attempts(target_url, attempt, exception_kind,
status_code, final_url, headers, body, history_len, started_at, ended_at)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit import schemas
from lexaudit.functions import http as HT


def fetch_outcomes(attempts: DataFrame, retry_count: int = 2) -> DataFrame:
    """FET1-FET8, FET11: one ``fetched_pages`` row per target URL (robots
    columns say "not checked"; the crawl join fills them).

    The result is the first terminal attempt, else attempt ``retry_count+1``
    (attempts after it are ignored), else - the log was cut short or still
    runs - the last logged attempt, an error row. One grouped ``min_by`` and
    ``max_by`` per URL: a partial aggregate, no window and no sort of the log.
    """
    max_attempts = max(0, int(retry_count)) + 1
    a = attempts.filter(F.col("attempt") <= max_attempts)
    retry = HT.is_retryable(F.col("exception_kind"), F.col("status_code"))
    a = a.withColumn("_final", ~retry | (F.col("attempt") == max_attempts))
    row = F.struct("attempt", "exception_kind", "status_code", "final_url", "headers", "body",
                   "history_len", "ended_at")
    g = a.groupBy("target_url").agg(
        # Ties (a malformed log with a repeated attempt number) are broken
        # by start time and status so the result is deterministic.
        F.min_by(row, F.when(F.col("_final"), F.struct("attempt", "started_at", "status_code"))).alias("_result"),
        F.max_by(row, F.struct("attempt", "started_at", "status_code")).alias("_last"),
        F.min("started_at").alias("_start"),
        F.max_by(HT.header_value(F.col("headers"), "Retry-After"),
                 F.when(F.col("status_code") == 429, F.col("attempt"))).alias("_retry_after"),
        F.max(F.when(F.col("status_code") == 429, F.col("attempt"))).alias("_last429"))
    g = g.withColumn("r", F.coalesce("_result", "_last"))
    r = F.col("r")
    exc = r["exception_kind"]
    status = r["status_code"]
    err = F.when(exc.isNotNull(), HT.exception_error_kind(exc)).otherwise(HT.status_error_kind(status))
    # A last attempt that is still running has neither exception nor status.
    err = F.coalesce(err, F.when(F.col("_result").isNull(), F.lit("request_error")))
    # Rows of responses keep status and final URL; pure network errors do not.
    has_response = exc.isNull() | exc.isin("too_many_redirects", "request_error") | ~exc.isin(
        *HT.EXCEPTION_ERROR_KIND.keys())
    ok = err.isNull()
    ctype = F.coalesce(HT.header_value(r["headers"], "Content-Type"), F.lit(""))
    final_url = F.when(ok | has_response, F.coalesce(r["final_url"], F.lit(""))).otherwise(F.lit(""))
    elapsed = F.round((F.unix_micros(r["ended_at"].cast("timestamp"))
                       - F.unix_micros(F.col("_start").cast("timestamp"))).cast("double") / 1e6, 3)
    return g.select(
        "target_url",
        final_url.alias("final_url"),
        F.when(ok | has_response, status).cast("int").alias("status_code"),
        F.when(ok, r["headers"]).otherwise(F.array().cast(schemas.HEADERS)).alias("headers"),
        F.when(ok, ctype).otherwise(F.lit("")).alias("content_type"),
        F.when(ok & HT.is_html_response(ctype), F.coalesce(r["body"], F.lit(""))).otherwise(F.lit("")).alias("html"),
        err.alias("error_kind"),
        F.when(~ok, F.concat(err, F.lit(": attempt "), r["attempt"].cast("string"))).alias("error_message"),
        F.lit(False).alias("robots_checked"),
        F.lit(None).cast("boolean").alias("robots_allowed"),
        F.lit("robots_not_checked").alias("robots_decision"),
        F.lit(None).cast("string").alias("robots_url"),
        r["ended_at"].alias("fetched_at"),
        elapsed.alias("elapsed_sec"),
        F.when(ok, (F.coalesce(r["history_len"], F.lit(0)) > 0) | (final_url != F.col("target_url")))
        .otherwise((final_url != "") & (final_url != F.col("target_url"))).alias("redirect_happened"),
        F.when(ok, HT.content_length(HT.header_value(r["headers"], "Content-Length"), r["body"]))
        .alias("content_length"),
        r["attempt"].alias("attempts_used"),
        F.when(F.col("_last429").isNotNull(), HT.retry_after_seconds(F.col("_retry_after"))).alias("retry_after_sec"),
    )


def outcome_label(pages: DataFrame) -> DataFrame:
    """FET8: success / error / blocked."""
    blocked = F.coalesce(F.col("robots_allowed").eqNullSafe(F.lit(False)), F.lit(False))
    return pages.withColumn("outcome", F.when(blocked, F.lit("blocked"))
                            .when(F.col("error_kind").isNull(), F.lit("success")).otherwise(F.lit("error")))


def errors_by_kind(pages: DataFrame) -> DataFrame:
    """FET9: error rows by kind."""
    p = outcome_label(pages).filter(F.col("outcome") == "error")
    return p.groupBy("error_kind").agg(F.count(F.lit(1)).alias("n"))


def crawl_join(targets: DataFrame, fetched: DataFrame, robots: DataFrame | None = None,
               prefetched: DataFrame | None = None) -> DataFrame:
    """FET10: per target URL, a prefetched row is reused (target_url
    overwritten); else a robots-blocked row; else the fetched row with the
    robots decision attached. ``targets`` has ``target_url``; ``robots`` has
    ``(url, allowed, robots_decision, robots_url)``."""
    t = targets.select("target_url").distinct() if "page_key" not in targets.columns else targets
    cols = [f.name for f in schemas.FETCHED_PAGES.fields]
    out = t.select("target_url")
    pre = None
    if prefetched is not None:
        # Only targets have rows; other prefetched pages are left out.
        pre = prefetched.select(*cols).join(out, "target_url", "left_semi").withColumn("_src", F.lit("prefetched"))
    # A target without any fetch record counts as a request error.
    f = fetched.select(*cols).withColumn("_has", F.lit(True))
    if robots is not None:
        rb = robots.select(F.col("url").alias("target_url"), F.col("allowed").alias("_allowed"),
                           F.col("robots_decision").alias("_decision"), F.col("robots_url").alias("_robots_url"))
        f = out.join(rb, "target_url", "left").join(f, "target_url", "left")
        blocked = F.coalesce(~F.col("_allowed"), F.lit(False))
        f = f.select(
            "target_url",
            F.when(blocked, F.lit("")).otherwise(F.col("final_url")).alias("final_url"),
            F.when(~blocked, F.col("status_code")).alias("status_code"),
            F.when(blocked, F.array().cast(schemas.HEADERS)).otherwise(F.col("headers")).alias("headers"),
            F.when(blocked, F.lit("")).otherwise(F.col("content_type")).alias("content_type"),
            F.when(blocked, F.lit("")).otherwise(F.col("html")).alias("html"),
            F.when(~blocked, F.when(F.col("_has").isNull(), F.lit("request_error"))
                   .otherwise(F.col("error_kind"))).alias("error_kind"),
            F.when(~blocked, F.when(F.col("_has").isNull(), F.lit("no fetch record"))
                   .otherwise(F.col("error_message"))).alias("error_message"),
            F.col("_allowed").isNotNull().alias("robots_checked"),
            F.col("_allowed").alias("robots_allowed"),
            F.coalesce(F.col("_decision"), F.lit("robots_not_checked")).alias("robots_decision"),
            F.col("_robots_url").alias("robots_url"),
            "fetched_at",
            F.when(blocked, F.lit(0.0)).otherwise(F.col("elapsed_sec")).alias("elapsed_sec"),
            F.when(blocked, F.lit(False)).otherwise(F.col("redirect_happened")).alias("redirect_happened"),
            F.when(~blocked, F.col("content_length")).alias("content_length"),
            F.when(blocked, F.lit("blocked")).otherwise(F.lit("fetched")).alias("_src"),
        )
    else:
        f = out.join(f, "target_url", "left").withColumn("_src", F.lit("fetched"))
        f = f.withColumn("error_kind", F.when(F.col("_has").isNull(), F.lit("request_error"))
                         .otherwise(F.col("error_kind"))).drop("_has")
    if pre is None:
        return f
    pre_keys = pre.select("target_url").distinct()
    return pre.unionByName(f.join(pre_keys, "target_url", "left_anti"))
