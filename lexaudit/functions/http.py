"""Fetch-log column expressions (FET2-FET7) and stdlib-compatible
percent coding used by the robots rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexaudit.functions.urls import py_strip

# Exception kinds of the attempt log that are retried, and the
# error kind each exception kind maps to (connect timeouts count as timeouts,
# SSL errors are terminal even though they are connection errors).
RETRYABLE_EXCEPTIONS = ("timeout", "connect_timeout", "read_timeout", "connection_error")
EXCEPTION_ERROR_KIND = {
    "timeout": "timeout",
    "connect_timeout": "timeout",
    "read_timeout": "timeout",
    "ssl_error": "ssl_error",
    "too_many_redirects": "redirect_error",
    "connection_error": "connection_error",
}


def header_value(headers: Column, name: str) -> Column:
    """First header value with this name (case-insensitive), else NULL."""
    hits = F.filter(headers, lambda h: F.lower(h["key"]) == name.lower())
    return F.try_element_at(hits, F.lit(1))["value"]


def exception_error_kind(kind: Column) -> Column:
    """FET2: exception kind -> error_kind (unknown kinds: request_error)."""
    m = F.create_map(*[F.lit(x) for kv in EXCEPTION_ERROR_KIND.items() for x in kv])
    return F.coalesce(m[kind], F.lit("request_error"))


def status_error_kind(status: Column) -> Column:
    """FET3: HTTP status -> error_kind (NULL for < 400)."""
    return (F.when(status == 429, F.lit("too_many_requests"))
            .when((status >= 500) & (status <= 599), F.lit("server_error"))
            .when(status == 403, F.lit("forbidden"))
            .when(status == 404, F.lit("not_found"))
            .when(status == 410, F.lit("gone"))
            .when(status >= 400, F.concat(F.lit("http_"), status.cast("string"))))


def is_retryable(exception_kind: Column, status: Column) -> Column:
    """Timeout and connection errors, 429 and 5xx are retried."""
    return F.when(exception_kind.isNotNull(), exception_kind.isin(*RETRYABLE_EXCEPTIONS)) \
        .otherwise((status == 429) | ((status >= 500) & (status <= 599)))


def retry_after_seconds(value: Column, now: Column | None = None) -> Column:
    """FET4: seconds, or an HTTP date minus now; floor 0; bad -> NULL."""
    v = py_strip(F.coalesce(value, F.lit("")))
    secs = v.try_cast("double")
    no_wday = F.regexp_replace(v, "^[A-Za-z]{3},\\s*", "")
    ts = F.try_to_timestamp(no_wday, F.lit("dd MMM yyyy HH:mm:ss zzz"))
    now = now if now is not None else F.current_timestamp()
    delta = F.unix_micros(ts).cast("double") / 1e6 - F.unix_micros(now).cast("double") / 1e6
    return (F.when(v == "", F.lit(None).cast("double"))
            .when(secs.isNotNull(), F.greatest(F.lit(0.0), secs))
            .when(ts.isNotNull(), F.greatest(F.lit(0.0), delta)))


def is_html_response(content_type: Column) -> Column:
    """FET5: HTML body kept for HTML types or an empty type."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return ct.contains("text/html") | ct.contains("application/xhtml+xml") | (ct == "")


def content_length(header: Column, body: Column) -> Column:
    """FET6: integer Content-Length header, else the body's byte length."""
    return F.coalesce(py_strip(header).try_cast("long"), F.octet_length(F.coalesce(body, F.lit(""))).cast("long"))


def py_unquote(c: Column) -> Column:
    """``urllib.parse.unquote``: %XX decoding as UTF-8; '+' stays '+'; a
    '%' without two hex digits stays."""
    esc = F.regexp_replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), "\\+", "%2B")
    return F.url_decode(esc)


def py_quote(c: Column) -> Column:
    """``urllib.parse.quote(s, safe='/')`` from Java's form encoder."""
    e = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e
