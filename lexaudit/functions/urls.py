"""URL column algebra (URL1-URL5, URL11-URL14) as native expressions.

``with_normalized_url`` follows the stdlib split rules (scheme, ``//netloc``,
``#fragment``, ``?query``, ``;params`` of the last segment) with plain
regular expressions, so it never fails on odd input (``parse_url`` returns
NULL on a raw space).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexaudit.functions.text import PY_WS

# File suffixes that are not HTML pages, schemes rejected by
# name, and query keys dropped as trackers.
NON_HTML_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".zip",
                       ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".mp4")
EXPLICIT_INVALID_SCHEMES = ("mailto", "tel", "javascript")
TRACKING_QUERY_PARAMS = ("fbclid", "gclid")
# Second-level suffixes of the fallback registered-domain rule
# (under them a registered domain has three labels).
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "com.cn", "com.hk",
                      "com.sg", "com.tr", "edu.au", "go.jp", "gov.uk", "ne.jp", "or.jp")

_SCHEME_RE = "^([A-Za-z][A-Za-z0-9+.-]*):"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` (Unicode white space on both ends)."""
    return F.regexp_replace(c, "^[" + PY_WS + "]+|[" + PY_WS + "]+$", "")


def split_url(raw: Column) -> dict[str, Column]:
    """Split like ``urlparse``: scheme (lower-cased), netloc, path (without
    ``;params``), query, fragment, and a flag for bad IPv6 brackets."""
    v = F.regexp_replace(raw, "[\\t\\r\\n]", "")
    scheme = F.lower(F.regexp_extract(v, _SCHEME_RE, 1))
    rest = F.when(scheme != "", F.regexp_replace(v, _SCHEME_RE, "")).otherwise(v)
    has_auth = rest.startswith("//")
    netloc = F.when(has_auth, F.regexp_extract(rest, "^//([^/?#]*)", 1)).otherwise(F.lit(""))
    after = F.when(has_auth, F.regexp_replace(rest, "^//[^/?#]*", "")).otherwise(rest)
    fragment = F.regexp_extract(after, "#(.*)$", 1)
    no_frag = F.regexp_replace(after, "#.*$", "")
    query = F.regexp_extract(no_frag, "\\?(.*)$", 1)
    path_params = F.regexp_replace(no_frag, "\\?.*$", "")
    # ;params: from the first ';' after the last '/' (or the first ';').
    path = F.regexp_replace(path_params, "^((?:.*/)?[^/;]*);[^/]*$", "$1")
    bad_brackets = ((netloc.contains("[") & ~netloc.contains("]"))
                    | (netloc.contains("]") & ~netloc.contains("[")))
    return {"scheme": scheme, "netloc": netloc, "path": path, "query": query,
            "fragment": fragment, "bad_brackets": bad_brackets}


def strip_default_port(scheme: Column, netloc: Column) -> Column:
    """URL2: drop ``:80`` for http and ``:443`` for https (suffix test)."""
    return (F.when((scheme == "http") & netloc.endswith(":80"), F.regexp_replace(netloc, ":80$", ""))
            .when((scheme == "https") & netloc.endswith(":443"), F.regexp_replace(netloc, ":443$", ""))
            .otherwise(netloc))


def normalize_path(path: Column) -> Column:
    """URL3: '' or '/' -> ''; strip trailing slashes; one leading slash."""
    stripped = F.regexp_replace(path, "/+$", "")
    lead = F.when(stripped.startswith("/"), stripped).otherwise(F.concat(F.lit("/"), stripped))
    return F.when((path == "") | (path == "/"), F.lit("")).otherwise(lead)


def path_suffix(path: Column) -> Column:
    """Lower-cased suffix of the last path segment ('' if none)."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, "^.+(\\.[^.]+)$", 1))


def has_non_html_extension(path: Column, exclude_pdf: bool = True) -> Column:
    """URL4."""
    exts = [e for e in NON_HTML_EXTENSIONS if exclude_pdf or e != ".pdf"]
    return path_suffix(path).isin(*exts)


def _decode_component(c: Column) -> Column:
    """``unquote_plus`` semantics: '+' is a space; a '%' not followed by two
    hex digits stays as it is."""
    escaped = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(escaped)


def _encode_component(c: Column) -> Column:
    """``quote_plus(safe='')``: Java's encoder plus two fix-ups."""
    e = F.url_encode(c)
    return F.replace(F.replace(e, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_query(query: Column) -> Column:
    """URL5: split pairs, keep blank values, drop fbclid/gclid (any case),
    re-encode as ``urlencode`` does; ``utm_*`` stays."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(
        _decode_component(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
        _decode_component(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda kv: ~F.lower(kv["k"]).isin(*TRACKING_QUERY_PARAMS))
    enc = F.transform(kept, lambda kv: F.concat(_encode_component(kv["k"]), F.lit("="),
                                                _encode_component(kv["v"])))
    return F.array_join(enc, "&")



def _fenced(value: Column) -> Column:
    """``value`` unchanged, as an expression that Catalyst treats as
    non-deterministic: filters and the not-null tests that joins add on the
    column stay above its projection instead of inlining all stages of it."""
    return F.when(F.spark_partition_id() >= 0, value)


def with_normalized_url(df, raw_col: str, exclude_pdf: bool = True,
                        out_url: str = "normalized_url", out_reason: str = "skip_reason"):
    """URL1 as staged projections: ``(normalized_url, skip_reason)``,
    but each intermediate part is computed once (one inlined expression
    would repeat the split regexes and overflow the generated-code limit)."""
    tmp = ["_v", "_vv", "_scheme", "_rest", "_netloc", "_after", "_path", "_query", "_host", "_npath", "_nq"]
    d = df.withColumn("_v", py_strip(F.coalesce(F.col(raw_col), F.lit(""))))
    d = d.withColumn("_vv", F.regexp_replace(F.col("_v"), "[\\t\\r\\n]", ""))
    d = d.withColumn("_scheme", F.lower(F.regexp_extract(F.col("_vv"), _SCHEME_RE, 1)))
    d = d.withColumn("_rest", F.when(F.col("_scheme") != "", F.regexp_replace(F.col("_vv"), _SCHEME_RE, ""))
                     .otherwise(F.col("_vv")))
    has_auth = F.col("_rest").startswith("//")
    d = d.withColumn("_netloc", F.when(has_auth, F.regexp_extract(F.col("_rest"), "^//([^/?#]*)", 1))
                     .otherwise(F.lit(""))) \
        .withColumn("_after", F.when(has_auth, F.regexp_replace(F.col("_rest"), "^//[^/?#]*", ""))
                    .otherwise(F.col("_rest")))
    d = d.withColumn("_path", F.regexp_replace(F.regexp_extract(F.col("_after"), "^([^?#]*)", 1),
                                               "^((?:.*/)?[^/;]*);[^/]*$", "$1")) \
        .withColumn("_query", F.regexp_extract(F.regexp_replace(F.col("_after"), "#.*$", ""), "\\?(.*)$", 1))
    d = d.withColumn("_host", strip_default_port(F.col("_scheme"), F.lower(F.col("_netloc")))) \
        .withColumn("_npath", normalize_path(F.col("_path"))) \
        .withColumn("_nq", clean_query(F.col("_query")))
    netloc = F.col("_netloc")
    bad = (netloc.contains("[") & ~netloc.contains("]")) | (netloc.contains("]") & ~netloc.contains("["))
    scheme = F.col("_scheme")
    reason = (F.when(F.col("_v") == "", F.lit("empty_value"))
              .when(scheme.isin(*EXPLICIT_INVALID_SCHEMES), F.concat(F.lit("unsupported_scheme:"), scheme))
              .when(~scheme.isin("http", "https") | (netloc == "") | bad, F.lit("invalid_url"))
              .when(has_non_html_extension(F.col("_npath"), exclude_pdf), F.lit("non_html_extension")))
    d = d.withColumn(out_reason, reason)
    base = F.concat(scheme, F.lit("://"), F.col("_host"), F.col("_npath"))
    full = F.when(F.col("_nq") != "", F.concat(base, F.lit("?"), F.col("_nq"))).otherwise(base)
    url = F.when(F.col(out_reason).isNull(), full).when(F.col(out_reason) == "non_html_extension", base).otherwise(F.lit(""))
    return d.withColumns({out_url: _fenced(url), out_reason: _fenced(F.col(out_reason))}).drop(*tmp)


def url_host(url: Column) -> Column:
    """Lower-cased host of an absolute URL (user info and port removed)."""
    netloc = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    hostport = F.regexp_replace(netloc, "^.*@", "")
    return F.lower(F.regexp_replace(hostport, ":[0-9]*$", ""))


def url_origin(url: Column) -> Column:
    """URL11: ``scheme://netloc`` of an http(s) URL, else NULL."""
    o = F.regexp_extract(url, "^([Hh][Tt][Tt][Pp][Ss]?://[^/?#]+)", 1)
    return F.when(o != "", o)


def registered_domain(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """URL12 fallback rule: all-digit (IP) host -> itself; <= 2 labels ->
    itself; under a known two-label suffix -> last 3 labels; else last 2."""
    h = F.regexp_replace(py_strip(F.lower(F.coalesce(host, F.lit("")))), "\\.+$", "")
    labels = F.filter(F.split(h, "\\."), lambda x: x != "")
    n = F.size(labels)
    last2 = F.array_join(F.slice(labels, -2, 2), ".")
    last3 = F.array_join(F.slice(labels, -3, 3), ".")
    return (F.when(h == "", h)
            .when(h.rlike("^[\\p{Nd}.]*\\p{Nd}[\\p{Nd}.]*$"), h)
            .when(n <= 2, h)
            .when(last2.isin(*suffixes), last3)
            .otherwise(last2))


def in_scope(host: Column, root_host: Column, include_subdomains: Column) -> Column:
    """URL13: same host, or same registered domain with subdomains on."""
    return F.when(include_subdomains, registered_domain(host) == registered_domain(root_host)) \
        .otherwise(host == root_host)


def first_matching_pattern(url: Column, patterns: Sequence[str]) -> Column:
    """URL6: the first pattern, in list order, that is a substring."""
    pats = [p for p in patterns if p and p.strip()]
    if not pats:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(url.contains(F.lit(p)), F.lit(p)) for p in pats])


def _remove_dot_segments(segments: Column) -> Column:
    """Stdlib join rule: '..' pops (never above the root), '.' is skipped;
    a trailing '.' or '..' leaves a trailing slash."""
    init = F.array().cast("array<string>")
    folded = F.aggregate(segments, init, lambda acc, s: F.when(
        s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s)))
    last = F.element_at(segments, -1)
    folded = F.when(last.isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded)
    joined = F.array_join(folded, "/")
    # With a netloc the serialised path always starts with '/'.
    return (F.when(joined == "", F.lit("/"))
            .when(~joined.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined))


def with_resolved_url(df, base_col: str, ref_col: str, out_col: str):
    """URL14: ``urljoin(base, ref)`` for http(s) bases, as staged
    projections (each part is computed once; one inlined expression would
    repeat the parts in every branch)."""
    tmp = ["_j_r0", "_j_bs", "_j_r", "_j_rs", "_j_bauth", "_j_bpath", "_j_bq", "_j_bnf", "_j_rest",
           "_j_tail", "_j_segs", "_j_path"]
    d = df.withColumn("_j_r0", F.coalesce(F.col(ref_col), F.lit("")))
    d = d.withColumn("_j_bs", F.lower(F.regexp_extract(F.col(base_col), _SCHEME_RE, 1)))
    r0 = F.col("_j_r0")
    # 'http:g' against an http base is the relative reference 'g'.
    d = d.withColumn("_j_r", F.when((F.lower(F.regexp_extract(r0, _SCHEME_RE, 1)) == F.col("_j_bs"))
                                    & ~r0.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"),
                                    F.regexp_replace(r0, _SCHEME_RE, "")).otherwise(r0))
    r = F.col("_j_r")
    d = d.withColumn("_j_rs", F.lower(F.regexp_extract(r, _SCHEME_RE, 1)))
    d = d.withColumn("_j_bauth", F.concat(F.col("_j_bs"), F.lit("://"),
                                          F.regexp_extract(F.col(base_col), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    d = d.withColumn("_j_bpath", F.regexp_extract(F.col(base_col), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    d = d.withColumn("_j_bq", F.regexp_extract(F.regexp_replace(F.col(base_col), "#.*$", ""), "\\?(.*)$", 1))
    d = d.withColumn("_j_bnf", F.regexp_replace(F.col(base_col), "#.*$", ""))
    d = d.withColumn("_j_rest", F.regexp_extract(r, "^([^?#]*)", 1))
    d = d.withColumn("_j_tail", F.regexp_replace(r, "^[^?#]*", ""))
    rest = F.col("_j_rest")
    # Segments to fold: absolute path alone, or base directory + relative
    # path with empty inner segments removed.
    base_dir = F.split(F.col("_j_bpath"), "/")
    base_dir = F.when(F.element_at(base_dir, -1) != "",
                      F.slice(base_dir, 1, F.greatest(F.size(base_dir) - 1, F.lit(0)))).otherwise(base_dir)
    merged = F.concat(base_dir, F.split(rest, "/"))
    d = d.withColumn("_j_segs", F.when(rest.startswith("/"), F.split(rest, "/")).otherwise(merged))
    segs = F.col("_j_segs")
    n = F.size(segs)
    inner = F.filter(F.slice(segs, 2, F.greatest(n - 2, F.lit(0))), lambda x: x != "")
    cleaned = F.when(rest.startswith("/") | (n < 2), segs).otherwise(
        F.concat(F.slice(segs, 1, 1), inner, F.slice(segs, -1, 1)))
    d = d.withColumn("_j_segs", cleaned)
    d = d.withColumn("_j_path", _remove_dot_segments(F.col("_j_segs")))
    bq = F.when(F.col("_j_bq") != "", F.concat(F.lit("?"), F.col("_j_bq"))).otherwise(F.lit(""))
    has_q = F.col("_j_tail").startswith("?")
    out = (F.when(r == "", F.col(base_col))
           .when((F.col("_j_rs") != "") & ((F.col("_j_rs") != F.col("_j_bs"))
                                          | r.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")), r)
           .when(r.startswith("//"), F.concat(F.col("_j_bs"), F.lit(":"), r))
           .when(r.startswith("#"), F.concat(F.col("_j_bnf"), r))
           .when(rest == "", F.concat(F.col("_j_bauth"), F.col("_j_bpath"),
                                      F.when(has_q, F.lit("")).otherwise(bq), F.col("_j_tail")))
           .otherwise(F.concat(F.col("_j_bauth"), F.col("_j_path"), F.col("_j_tail"))))
    return d.withColumn(out_col, _fenced(out)).drop(*tmp)
