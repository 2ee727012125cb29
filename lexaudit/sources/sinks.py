"""Sinks (SNK1-SNK13): named tables with a fixed column order, written as
CSV (UTF-8 with a byte-order mark on the header, no index) or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column order of every report table.
COLUMNS = {
    "target_urls": ["original_url", "normalized_url", "source_type"],
    "target_urls_domain": ["original_url", "normalized_url", "source_type", "discovered_from"],
    "url_load_skipped": ["original_url", "normalized_url", "skip_reason"],
    "sitemap_sources": ["sitemap_url", "discovered_from", "fetch_status", "url_count"],
    "discovered_urls": ["normalized_url", "source_type", "discovered_from", "depth"],
    "wp_api_sources": ["api_url", "discovered_from", "fetch_status", "url_count", "page_count"],
    "crawl_success": ["target_url", "final_url", "status_code", "content_type", "content_length", "elapsed_sec",
                      "redirect_happened", "fetched_at"],
    "crawl_errors": ["target_url", "final_url", "status_code", "error_kind", "error_message", "fetched_at"],
    "robots_blocked_urls": ["url", "normalized_url", "robots_decision", "fetched_at"],
    "url_audit": ["url", "final_url", "status_code", "robots_txt", "noindex_status", "noindex_source",
                  "content_type", "extracted_chars", "extraction_success", "included_in_analysis",
                  "excluded_reason"],
    "noindex_urls": ["url", "final_url", "status_code", "noindex_source", "noindex_value",
                     "included_in_analysis", "detected_at"],
    "extracted_texts": ["url", "final_url", "status_code", "extracted_chars", "extraction_method",
                        "included_in_analysis", "extracted_text"],
    "raw_frequency_before_user_stopwords": ["rank", "keyword", "freq"],
    "keyword_frequency": ["rank", "keyword", "freq"],
}


# Headers of the keyword exports.
_KEYWORD_HEADERS = {"rank": "順位", "keyword": "キーワード", "freq": "出現数"}
EXPORTED = {"raw_frequency_before_user_stopwords": _KEYWORD_HEADERS, "keyword_frequency": _KEYWORD_HEADERS}


def crawl_tables(fetched: DataFrame) -> dict[str, DataFrame]:
    """SNK6-SNK8 from ``fetched_pages``."""
    blocked = F.coalesce(F.col("robots_allowed").eqNullSafe(F.lit(False)), F.lit(False))
    return {
        "crawl_success": fetched.filter(~blocked & F.col("error_kind").isNull()),
        "crawl_errors": fetched.filter(~blocked & F.col("error_kind").isNotNull()),
        "robots_blocked_urls": fetched.filter(blocked).select(
            F.col("target_url").alias("url"), F.col("target_url").alias("normalized_url"), "robots_decision",
            "fetched_at"),
    }


def report(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in report order, under their exported names."""
    return df.select(*[F.col(c).alias(EXPORTED.get(table, {}).get(c, c)) for c in COLUMNS[table]])


def write_csv(df: DataFrame, path: str, table: str | None = None, bom: bool = True,
              mode: str = "overwrite") -> None:
    """CSV with header; a BOM is written as U+FEFF in front of the first
    header name (Spark's CSV reader drops it again)."""
    out = report(df, table) if table else df
    if bom and out.columns:
        first = out.columns[0]
        out = out.withColumnRenamed(first, "﻿" + first)
    out.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)
