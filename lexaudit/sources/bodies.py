"""Stored response bodies (SRC8, SRC9): files of any content type with a
manifest of their responses -> robots and sitemap tables.

The manifest has ``(file, url, status_code, content_type)``, ``file`` being
the name of the stored file. Bodies are inflated by content type, by a
``.gz`` URL or by their first bytes, and decoded by the response's charset
with replacement.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A body that inflates to more is an error, never a shorter body. Sitemaps
# may have 50 MB.
MAX_BODY = 64 * 1024 * 1024

# Content types of gzip bodies.
GZIP_TYPES = ("application/gzip", "application/x-gzip")
GZIP_MAGIC = b"\x1f\x8b"
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([^\s;\"']+)", re.I)
_DECLARED = re.compile(rb"^\s*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)")
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def inflate(raw: bytes, most: int = MAX_BODY) -> bytes:
    """All members of a gzip body. ValueError: not gzip, cut short, or more
    than ``most`` bytes (no more than these are ever held)."""
    out = bytearray()
    while raw:
        member = zlib.decompressobj(wbits=31)
        try:
            out += member.decompress(raw, most + 1 - len(out))
        except zlib.error as bad:
            raise ValueError("bad_gzip") from bad
        if len(out) > most:
            raise ValueError("body_too_large")
        if not member.eof:
            raise ValueError("bad_gzip")
        # Members may be followed by zero bytes.
        raw = member.unused_data.lstrip(b"\0")
    return bytes(out)


def charset_of(content_type: str, raw: bytes) -> str:
    """The charset a response names; text without one is Latin-1; for other
    types a byte order mark, the XML declaration, or UTF-8."""
    named = _CHARSET.search(content_type)
    if named:
        return named.group(1)
    if "text" in content_type:
        return "iso-8859-1"
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return name
    declared = _DECLARED.match(raw[:1024])
    return declared.group(1).decode("ascii") if declared else "utf-8"


def body_text(raw: bytes | None, url: str | None, content_type: str | None, most: int = MAX_BODY):
    """(text, error) of one stored body. No content: empty text."""
    raw, kind = bytes(raw or b""), (content_type or "").lower()
    try:
        if (url or "").lower().endswith(".gz") or any(t in kind for t in GZIP_TYPES) or raw.startswith(GZIP_MAGIC):
            if not raw.startswith(GZIP_MAGIC):
                raise ValueError("bad_gzip")
            raw = inflate(raw, most)
        elif len(raw) > most:
            raise ValueError("body_too_large")
    except ValueError as error:
        return None, str(error)
    try:
        text = raw.decode(charset_of(kind, raw), "replace")
    except LookupError:
        text = raw.decode("utf-8", "replace")
    return text.removeprefix("﻿"), None


def decoded(content: Column, url: Column, content_type: Column, most: int = MAX_BODY) -> Column:
    """struct (body, error) of a binary column."""
    def decode(raw: pd.Series, urls: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([body_text(*row, most) for row in zip(raw, urls, kinds)], columns=["body", "error"])

    return F.pandas_udf(decode, "body string, error string").asNondeterministic()(content, url, content_type)


def stored_bodies(spark: SparkSession, path: str, manifest: DataFrame, most: int = MAX_BODY) -> DataFrame:
    """``(url, origin, source_status, content_type, body, body_error)``: one
    row per manifest row. A response without a stored file has an empty body
    where its status is set; a NULL status stays NULL (request failed).
    ``body_error`` is ``bad_gzip`` or ``body_too_large``; its body is NULL."""
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content")
    rows = manifest.select(F.col("file"), F.col("url"), F.col("status_code").cast("int").alias("source_status"),
                           F.col("content_type"))
    rows = rows.join(files, "file", "left")
    rows = rows.withColumn("_text", decoded(F.col("content"), F.col("url"), F.col("content_type"), most))
    return rows.select("url", F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1).alias("origin"),
                       "source_status", "content_type", F.col("_text.body").alias("body"),
                       F.col("_text.error").alias("body_error"))


def robots_table(stored: DataFrame) -> DataFrame:
    """SRC8: ``(origin, robots_url, source_status, body)``, one row per
    origin: the smallest URL where several are stored."""
    robots = stored.filter(F.regexp_extract("url", "^[^?#]*/([^/?#]*)$", 1) == "robots.txt")
    first = robots.groupBy("origin").agg(F.min_by(F.struct("url", "source_status", "body"), "url").alias("_r"))
    return first.select("origin", F.col("_r.url").alias("robots_url"), "_r.source_status", "_r.body")


def sitemap_table(stored: DataFrame) -> DataFrame:
    """SRC9: ``(sitemap_url, status_code, body)`` of all bodies that are no
    robots file. A body that could not be inflated is NULL, which the sitemap
    parser reports as ``parse_error``."""
    return stored.filter(F.regexp_extract("url", "^[^?#]*/([^/?#]*)$", 1) != "robots.txt").select(
        F.col("url").alias("sitemap_url"), F.col("source_status").alias("status_code"), "body")
