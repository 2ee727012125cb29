"""Page audit and text extraction (EXT1, EXT2, EXT4, EXT7, EXT9-EXT15).

Input: ``fetched_pages`` rows plus a ``page_key``. Output: ``text_audit``.
HTML is read only for pages that can reach extraction (not blocked, no fetch
error, HTML-like), once; the fallback text is only made for pages whose
primary text is shorter than ``min_text_length``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.functions.urls import py_strip
from lexaudit.operators import html as H
from lexaudit.settings import Settings

# Fetch error kind -> exclusion reason (unknown kinds pass
# through unchanged, an empty kind is crawl_error).
ERROR_REASONS = {
    "http_403": "status_403",
    "http_404": "status_404",
    "gone": "status_410",
    "http_429": "status_429",
    "http_5xx": "status_5xx",
    "timeout": "timeout",
    "ssl_error": "ssl_error",
    "connection_error": "connection_error",
    "redirect_error": "redirect_error",
    "request_exception": "request_error",
    "request_error": "request_error",
    "server_error": "status_5xx",
    "too_many_requests": "status_429",
    "forbidden": "status_403",
    "not_found": "status_404",
}


def error_reason(kind: Column) -> Column:
    """EXT11."""
    m = F.create_map(*[F.lit(x) for kv in ERROR_REASONS.items() for x in kv])
    k = F.coalesce(kind, F.lit(""))
    return F.coalesce(m[k], F.when(k != "", k).otherwise(F.lit("crawl_error")))


def robots_txt_status(robots_checked: Column, robots_allowed: Column) -> Column:
    """EXT12."""
    return (F.when(~F.coalesce(robots_checked, F.lit(False)), F.lit("not_checked"))
            .when(robots_allowed.eqNullSafe(F.lit(False)), F.lit("blocked"))
            .otherwise(F.lit("allowed")))


def is_html_like(content_type: Column, html: Column) -> Column:
    """EXT4."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return (ct.contains("text/html") | ct.contains("application/xhtml+xml")
            | ((ct == "") & (F.coalesce(html, F.lit("")) != "")))


def header_noindex(headers: Column) -> Column:
    """EXT1: first ``X-Robots-Tag`` header (any case) whose value holds
    'noindex' -> its stripped value, else NULL."""
    hits = F.filter(headers, lambda h: (F.lower(h["key"]) == "x-robots-tag")
                    & F.lower(py_strip(F.coalesce(h["value"], F.lit("")))).contains("noindex"))
    return py_strip(F.try_element_at(hits, F.lit(1))["value"])


def prepend_title(title: Column, body: Column) -> tuple[Column, Column]:
    """EXT9: (text, title_added). Not added when empty, or when equal to or
    contained in the first body line."""
    first_line = py_strip(F.split(body, "\n").getItem(0))
    added = (title != "") & ((body == "") | ~((title == first_line) | first_line.contains(title)))
    text = (F.when(title == "", body)
            .when(body == "", title)
            .when(added, F.concat(title, F.lit("\n"), body))
            .otherwise(body))
    return text, added


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later expressions read but do not repeat
    (Spark keeps a projection above a generator apart from one below)."""
    return df.select("*", F.explode(F.array(value)).alias(name + "_")).withColumn(name, F.col(name + "_")).drop(name + "_")


def analyze_pages(pages: DataFrame, settings: Settings, key_col: str = "page_key",
                  parse: Callable[[str], dict] = H.fold_page) -> DataFrame:
    """EXT14: ``fetched_pages`` (+ key) -> ``text_audit`` (+ key), row by row:
    one pass over each page, no exchange. A page for which ``parse`` raises
    gets an ``extract_exception`` row (EXT13)."""
    s = settings
    min_len = max(0, int(s.min_text_length))
    p = pages.withColumn("page_key", F.col(key_col)) if key_col != "page_key" else pages
    blocked = F.coalesce(F.col("robots_allowed").eqNullSafe(F.lit(False)), F.lit(False))
    p = (p.withColumn("_blocked", blocked)
         .withColumn("_error", F.col("error_kind").isNotNull() & ~F.col("_blocked"))
         .withColumn("_htmlish", is_html_like(F.col("content_type"), F.col("html")))
         .withColumn("_hdr_noindex", header_noindex(F.col("headers"))))
    # Meta robots only matters where the header did not decide and there is HTML.
    needed = ~F.col("_blocked") & ~F.col("_error") & (
        F.col("_htmlish") | (F.lit(bool(s.detect_noindex)) & F.col("_hdr_noindex").isNull()))
    p = H.with_parts(p, F.when(needed, F.col("html")), "_parts", parse)
    extracted = F.col("_htmlish") & ~F.col("_blocked") & ~F.col("_error")
    p = (p.withColumn("_raised", F.col("_parts.error"))
         .withColumn("_p", F.when(extracted, F.coalesce(H.primary_text("_parts"), F.lit(""))).otherwise(F.lit(""))))
    plen = F.length("_p")
    # The fallback is only made where the primary text is short.
    p = _once(p, "_f", F.when(extracted & (plen < min_len), H.fallback_text("_parts")))
    p = p.withColumn("_f", F.coalesce("_f", F.lit("")))
    flen = F.length("_f")
    p = _once(p, "_chosen", F.when((plen < min_len) & (flen > plen),
                                   F.struct(F.col("_f").alias("text"), F.lit("fallback").alias("method")))
              .otherwise(F.struct(F.col("_p").alias("text"),
                                  F.when(plen > 0, F.lit("primary")).otherwise(F.lit("")).alias("method"))))
    text, method = F.col("_chosen.text"), F.col("_chosen.method")
    if s.include_title:
        p = p.withColumn("_title", F.when(extracted, F.coalesce(H.title_text("_parts"), F.lit("")))
                         .otherwise(F.lit("")))
        text, added = prepend_title(F.col("_title"), F.col("_chosen.text"))
        method = (F.when(added & (method != ""), F.concat(method, F.lit("+title")))
                  .when(added, F.lit("title")).otherwise(method))
    a = p.select("*", text.alias("_text"), method.alias("_method"), H.meta_source("_parts").alias("meta_source"),
                 F.col("_parts.meta_content").alias("meta_value"))
    noindex_src = F.when(F.col("_hdr_noindex").isNotNull(), F.lit("x_robots_tag")).otherwise(F.col("meta_source"))
    noindex_val = F.when(F.col("_hdr_noindex").isNotNull(), F.col("_hdr_noindex")).otherwise(F.col("meta_value"))
    if s.detect_noindex:
        status = F.when(noindex_src.isNotNull(), F.lit("noindex")).otherwise(F.lit("not_noindex"))
    else:
        status = F.lit("unknown")
    early = F.col("_blocked") | F.col("_error") | F.col("_raised").isNotNull()
    a = (a.withColumn("noindex_status", F.when(early, F.lit("unknown")).otherwise(status))
         .withColumn("noindex_source", F.when(early | (F.col("noindex_status") != "noindex"), F.lit(""))
                     .otherwise(noindex_src))
         .withColumn("noindex_value", F.when(early | (F.col("noindex_status") != "noindex"), F.lit(""))
                     .otherwise(noindex_val)))
    chars = F.length(F.col("_text"))
    reason = (F.when(F.col("_blocked"), F.lit("robots_blocked"))
              .when(F.col("_error"), error_reason(F.col("error_kind")))
              .when(F.col("_raised").isNotNull(), F.concat(F.lit("extract_exception:"), F.col("_raised")))
              .when(~F.col("_htmlish"), F.lit("non_html"))
              .when(F.col("_text") == "", F.lit("extract_failed"))
              .when(chars < min_len, F.lit("low_text"))
              .when((F.col("noindex_status") == "noindex") & F.lit(bool(s.exclude_noindex_pages)),
                    F.lit("noindex_excluded"))
              .otherwise(F.lit("")))
    return a.select(
        "page_key",
        F.col("target_url").alias("url"),
        "final_url",
        "status_code",
        F.when(F.col("_blocked"), F.lit("blocked"))
        .otherwise(robots_txt_status(F.col("robots_checked"), F.col("robots_allowed"))).alias("robots_txt"),
        "noindex_status", "noindex_source", "noindex_value",
        "content_type",
        F.col("_text").alias("extracted_text"),
        chars.cast("int").alias("extracted_chars"),
        (F.col("_text") != "").alias("extraction_success"),
        F.col("_method").alias("extraction_method"),
        (reason == "").alias("included_in_analysis"),
        reason.alias("excluded_reason"),
        F.localtimestamp().alias("detected_at"),
    )


def audit_counts(audit: DataFrame) -> DataFrame:
    """EXT15: one row of counts."""
    return audit.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("included_in_analysis").alias("included"),
        F.count_if("extraction_success").alias("extraction_success"),
        F.count_if(F.col("noindex_status") == "noindex").alias("noindex"))


def url_audit_table(audit: DataFrame) -> DataFrame:
    """SNK9 columns."""
    return audit.select("url", "final_url", "status_code", "robots_txt", "noindex_status",
                        "noindex_source", "content_type", "extracted_chars", "extraction_success",
                        "included_in_analysis", "excluded_reason")


def noindex_table(audit: DataFrame) -> DataFrame:
    """SNK10 rows."""
    return audit.filter(F.col("noindex_status") == "noindex").select(
        "url", "final_url", "status_code", "noindex_source", "noindex_value",
        "included_in_analysis", "detected_at")


def extracted_texts_table(audit: DataFrame, settings: Settings) -> DataFrame:
    """SNK11 rows: pages with a text; none unless ``save_extracted_text`` is
    set."""
    wanted = (F.col("extracted_text") != "") & F.lit(bool(settings.save_extracted_text))
    return audit.filter(wanted).select(
        "url", "final_url", "status_code", "extracted_chars", "extraction_method",
        "included_in_analysis", "extracted_text")
