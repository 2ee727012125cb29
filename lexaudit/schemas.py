"""Row schemas of the tables that cross stage boundaries."""

from __future__ import annotations

from pyspark.sql import types as T

HEADER = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])
HEADERS = T.ArrayType(HEADER)

URL_INPUT = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("input_pos", T.LongType()),
    T.StructField("original_url", T.StringType()),
])

TARGET_URLS = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("input_pos", T.LongType()),
    T.StructField("original_url", T.StringType()),
    T.StructField("normalized_url", T.StringType()),
    T.StructField("source_type", T.StringType()),
])

SKIPPED_URLS = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("input_pos", T.LongType()),
    T.StructField("original_url", T.StringType()),
    T.StructField("normalized_url", T.StringType()),
    T.StructField("skip_reason", T.StringType()),
])

FETCH_ATTEMPTS = T.StructType([
    T.StructField("target_url", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("exception_kind", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("headers", HEADERS),
    T.StructField("body", T.StringType()),
    T.StructField("history_len", T.IntegerType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("ended_at", T.TimestampNTZType()),
])

FETCHED_PAGES = T.StructType([
    T.StructField("target_url", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("headers", HEADERS),
    T.StructField("content_type", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("error_kind", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("robots_checked", T.BooleanType()),
    T.StructField("robots_allowed", T.BooleanType()),
    T.StructField("robots_decision", T.StringType()),
    T.StructField("robots_url", T.StringType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
    T.StructField("elapsed_sec", T.DoubleType()),
    T.StructField("redirect_happened", T.BooleanType()),
    T.StructField("content_length", T.LongType()),
])

TEXT_AUDIT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("robots_txt", T.StringType()),
    T.StructField("noindex_status", T.StringType()),
    T.StructField("noindex_source", T.StringType()),
    T.StructField("noindex_value", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("extracted_text", T.StringType()),
    T.StructField("extracted_chars", T.IntegerType()),
    T.StructField("extraction_success", T.BooleanType()),
    T.StructField("extraction_method", T.StringType()),
    T.StructField("included_in_analysis", T.BooleanType()),
    T.StructField("excluded_reason", T.StringType()),
    T.StructField("detected_at", T.TimestampNTZType()),
])

MORPH_TOKENS = T.StructType([
    T.StructField("doc_key", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("surface", T.StringType()),
    T.StructField("base_form", T.StringType()),
    T.StructField("primary_pos", T.StringType()),
    T.StructField("subtype", T.StringType()),
])

ROBOTS_BODIES = T.StructType([
    T.StructField("origin", T.StringType()),
    T.StructField("robots_url", T.StringType()),
    T.StructField("source_status", T.IntegerType()),
    T.StructField("body", T.StringType()),
])

SITES = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("start_url", T.StringType()),
    T.StructField("include_subdomains", T.BooleanType()),
    T.StructField("max_pages", T.IntegerType()),
    T.StructField("max_depth", T.IntegerType()),
])

KEYWORD_FREQUENCY = T.StructType([
    T.StructField("rank", T.LongType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("freq", T.LongType()),
])
