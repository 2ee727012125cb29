"""Inputs derived from the driver tables.

The driver tables hold ``pages(page_id, url, html)`` and texts, but no URL
lists with defects, fetch logs, robots files, sitemaps or feeds. These are
derived here by plain expressions on ``pages`` so that their size grows with
the archive; the oracle SQL derives the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AUTH = "^(https?://[^/?#]*)"


def url_variants(pages: DataFrame) -> DataFrame:
    """``d_urls(site_id, input_pos, original_url)``: every page URL and seven
    altered copies (upper-case scheme/host, default port, trailing slash,
    fbclid, .pdf, mailto:, blank). Position = page_id * 8 + variant."""
    url = F.col("url")
    auth = F.regexp_extract(url, _AUTH, 1)
    after_auth = F.regexp_replace(url, _AUTH, "")
    before_q = F.regexp_extract(url, "^([^?#]*)", 1)
    from_q = F.regexp_replace(url, "^[^?#]*", "")
    before_hash = F.regexp_extract(url, "^([^#]*)", 1)
    from_hash = F.regexp_replace(url, "^[^#]*", "")
    host = F.regexp_extract(url, "^https?://([^/?#:]*)", 1)
    variants = F.array(
        url,
        F.concat(F.upper(auth), after_auth),
        F.concat(auth, F.when(url.startswith("https:"), F.lit(":443")).otherwise(F.lit(":80")), after_auth),
        F.concat(before_q, F.lit("/"), from_q),
        F.concat(before_hash, F.when(before_hash.contains("?"), F.lit("&")).otherwise(F.lit("?")),
                 F.lit("fbclid=x1"), from_hash),
        F.concat(before_q, F.lit(".pdf")),
        F.concat(F.lit("mailto:info@"), host),
        F.lit("  "),
    )
    site = F.col("site_id") if "site_id" in pages.columns else F.lit("")
    return pages.select(site.alias("site_id"), F.col("page_id"),
                        F.posexplode(variants).alias("variant", "original_url")) \
        .select("site_id", (F.col("page_id") * 8 + F.col("variant")).cast("long").alias("input_pos"),
                "original_url")


# Derived fetch outcomes for the audit queries, chosen by page_id % 10:
# 3 -> 404 not_found, 7 -> 503 server_error, 4 -> robots blocked,
# 5 -> application/pdf, 6 -> empty content type; others 200 text/html.
# Every page_id % 6 == 2 gets an X-Robots-Tag noindex header, every
# page_id % 4 == 1 a robots meta tag with noindex.
META_NOINDEX = '<meta name="robots" content="noindex, follow">'


def fetched_pages(pages: DataFrame) -> DataFrame:
    """``fetched_pages`` rows (plus ``page_key``) derived from ``pages``."""
    from lexaudit import schemas
    k = F.col("page_id") % 10
    html = F.when(F.col("page_id") % 4 == 1,
                  F.replace(F.col("html"), F.lit("<head>"), F.lit("<head>" + META_NOINDEX))).otherwise(F.col("html"))
    headers = F.when(F.col("page_id") % 6 == 2,
                     F.array(F.struct(F.lit("Content-Type").alias("key"), F.lit("text/html").alias("value")),
                             F.struct(F.lit("X-Robots-Tag").alias("key"), F.lit(" noindex, nofollow").alias("value")))
                     ).otherwise(F.array().cast(schemas.HEADERS))
    err = F.when(k == 3, F.lit("not_found")).when(k == 7, F.lit("server_error"))
    return pages.select(
        F.col("page_id").alias("page_key"),
        F.col("url").alias("target_url"),
        F.col("url").alias("final_url"),
        F.when(k == 3, F.lit(404)).when(k == 7, F.lit(503)).otherwise(F.lit(200)).alias("status_code"),
        F.when(k.isin(3, 7, 4), F.array().cast(schemas.HEADERS)).otherwise(headers).alias("headers"),
        F.when(k == 5, F.lit("application/pdf")).when(k == 6, F.lit(""))
        .when(k.isin(3, 7, 4), F.lit("")).otherwise(F.lit("text/html; charset=utf-8")).alias("content_type"),
        F.when(k.isin(3, 7, 4), F.lit("")).otherwise(F.coalesce(html, F.lit(""))).alias("html"),
        err.alias("error_kind"),
        F.when(err.isNotNull(), F.lit("derived error")).alias("error_message"),
        F.lit(True).alias("robots_checked"),
        F.when(k == 4, F.lit(False)).otherwise(F.lit(True)).alias("robots_allowed"),
        F.when(k == 4, F.lit("blocked_by_robots_txt")).otherwise(F.lit("allowed_by_robots_txt")).alias("robots_decision"),
        F.regexp_extract(F.col("url"), "^(https?://[^/?#]+)", 1).alias("robots_url"),
        F.lit(None).cast("timestamp_ntz").alias("fetched_at"),
        F.lit(0.0).alias("elapsed_sec"),
        F.lit(False).alias("redirect_happened"),
        F.octet_length(F.col("html")).cast("long").alias("content_length"),
    )


# Fixed robots bodies of the derived robots table (chosen per origin by
# length(origin) % 4: 0 -> BODY_A, 1 -> BODY_B, 2 -> 404, 3 -> 403).
ROBOTS_BODY_A = ("# robots for the test archive\n"
                 "User-agent: OtherBot\n"
                 "Disallow: /\n"
                 "\n"
                 "User-agent: lexaudit\n"
                 "User-agent: AnotherBot\n"
                 "Disallow: /fr/\n"
                 "Allow: /fr/1\n"
                 "Disallow: /es\n"
                 "\n"
                 "User-agent: *\n"
                 "Disallow: /en/\n"
                 "Sitemap: /sitemap.xml\n")
ROBOTS_BODY_B = ("User-agent: *\n"
                 "\n"
                 "Disallow: /en/1\n"
                 "User-agent: *\n"
                 "Disallow: /de/  # German pages\n"
                 "Allow: /\n"
                 "User-agent: *\n"
                 "Disallow: /\n")


def robots_bodies(pages: DataFrame) -> DataFrame:
    """``d_robots(origin, robots_url, source_status, body)``: one row per
    origin of the page URLs."""
    origin = F.regexp_extract(F.col("url"), "^(https?://[^/?#]+)", 1)
    o = pages.select(origin.alias("origin")).filter(F.col("origin") != "").distinct()
    k = F.length("origin") % 4
    return o.select(
        "origin",
        F.concat(F.col("origin"), F.lit("/robots.txt")).alias("robots_url"),
        F.when(k == 2, F.lit(404)).when(k == 3, F.lit(403)).otherwise(F.lit(200)).alias("source_status"),
        F.when(k == 0, F.lit(ROBOTS_BODY_A)).when(k == 1, F.lit(ROBOTS_BODY_B)).otherwise(F.lit("")).alias("body"))


def fetch_attempts(pages: DataFrame) -> DataFrame:
    """``d_attempts``: an attempt log per page URL chosen by page_id % 8:
    0 -> 200, 1 -> 403, 2 -> 404, 3 -> 410, 4 -> 429 then 200,
    5 -> 503 x3, 6 -> timeout x3 plus a late 200 (beyond the retries),
    7 -> SSL error. Every 16th page of kind 0 is a PDF; every page with
    page_id % 3 == 0 that succeeds was redirected once."""
    from lexaudit import schemas
    k = F.col("page_id") % 8
    plan = (F.when(k == 0, F.array(F.lit("200")))
            .when(k == 1, F.array(F.lit("403")))
            .when(k == 2, F.array(F.lit("404")))
            .when(k == 3, F.array(F.lit("410")))
            .when(k == 4, F.array(F.lit("429"), F.lit("200")))
            .when(k == 5, F.array(F.lit("503"), F.lit("503"), F.lit("503")))
            .when(k == 6, F.array(F.lit("timeout"), F.lit("timeout"), F.lit("timeout"), F.lit("200")))
            .otherwise(F.array(F.lit("ssl_error"))))
    a = pages.select("page_id", "url", "html", F.posexplode(plan).alias("i", "step"))
    status = F.col("step").try_cast("int")
    ok = status == 200
    pdf = (F.col("page_id") % 16 == 8)
    ctype = F.when(pdf, F.lit("application/pdf")).otherwise(F.lit("text/html; charset=utf-8"))
    clen = F.when(F.col("page_id") % 5 == 0, F.lit("abc")).otherwise(F.octet_length("html").cast("string"))
    hdrs = F.when(ok, F.array(F.struct(F.lit("Content-Type").alias("key"), ctype.alias("value")),
                              F.struct(F.lit("Content-Length").alias("key"), clen.alias("value"))))
    hdrs = F.when(status == 429, F.array(F.struct(F.lit("Retry-After").alias("key"), F.lit("0").alias("value")))) \
        .otherwise(F.coalesce(hdrs, F.array().cast(schemas.HEADERS)))
    redirected = ok & (F.col("page_id") % 3 == 0)
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_interval(
        secs=(F.col("page_id") * 100 + F.col("i") * 10).cast("decimal(18,6)"))
    return a.select(
        F.col("url").alias("target_url"),
        (F.col("i") + 1).cast("int").alias("attempt"),
        F.when(status.isNull(), F.col("step")).alias("exception_kind"),
        status.alias("status_code"),
        F.when(status.isNull(), F.lit(None).cast("string"))
        .when(redirected, F.concat(F.col("url"), F.lit("/"))).otherwise(F.col("url")).alias("final_url"),
        hdrs.alias("headers"),
        F.when(ok, F.col("html")).otherwise(F.lit("")).alias("body"),
        F.when(redirected, F.lit(1)).otherwise(F.lit(0)).alias("history_len"),
        start.alias("started_at"),
        (start + F.make_interval(secs=(F.col("i") + 1).cast("decimal(18,6)"))).alias("ended_at"),
    )


def tagged_tokens(docs: DataFrame) -> DataFrame:
    """``d_tokens``: a tagged-token table from ``documents``: letter runs in
    order, part of speech by run length (>= 7 common noun, 5-6 proper noun
    with base form '*', 4 suffix noun, 3 dependent noun, 2 particle,
    1 sign). Word separators are not tokens, so adjacent words form noun
    runs for the compound rules."""
    t = docs.select(F.col("doc_id").cast("string").alias("doc_key"),
                    F.posexplode(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")),
                                                      F.lit("(\\p{L}+)"), 1)).alias("pos", "surface"))
    n = F.length("surface")
    primary = F.when(n >= 3, F.lit("名詞")).when(n == 2, F.lit("助詞")).otherwise(F.lit("記号"))
    subtype = (F.when(n >= 7, F.lit("一般")).when(n >= 5, F.lit("固有名詞")).when(n == 4, F.lit("接尾"))
               .when(n == 3, F.lit("非自立")).when(n == 2, F.lit("格助詞")).otherwise(F.lit("一般")))
    base = F.when((n >= 5) & (n <= 6), F.lit("*")).otherwise(F.col("surface"))
    return t.select("doc_key", F.col("pos").cast("int").alias("pos"), "surface", base.alias("base_form"),
                    primary.alias("primary_pos"), subtype.alias("subtype"))


def sitemap_documents(pages: DataFrame) -> DataFrame:
    """``d_sitemaps(sitemap_url, status_code, body)`` per page origin:
    ``/sitemap.xml`` is an index naming ``/sitemap-pages.xml``, a relative
    ``sitemap-missing.xml`` (404) and itself; ``/sitemap-pages.xml`` is the
    urlset of the origin's page URLs in page_id order (malformed when
    length(origin) % 5 == 0); ``/sitemap_index.xml`` answers 404."""
    origin = F.regexp_extract(F.col("url"), "^(https?://[^/?#]+)", 1)
    p = pages.select(origin.alias("origin"), "page_id", "url").filter(F.col("origin") != "")
    per = p.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("_u"))
    locs = F.array_join(F.transform(F.col("_u"), lambda x: F.concat(F.lit("<url><loc>"),
                                                                       F.replace(x["url"], F.lit("&"), F.lit("&amp;")),
                                                                       F.lit("</loc></url>"))), "")
    urlset = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>'
                            '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), locs, F.lit("</urlset>"))
    urlset = F.when(F.length("origin") % 5 == 0, F.concat(F.lit("<urlset><url><loc>"), F.col("origin"))) \
        .otherwise(urlset)
    index = F.concat(F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>'),
                     F.col("origin"), F.lit("/sitemap-pages.xml</loc></sitemap><sitemap><loc>sitemap-missing.xml"
                                            "</loc></sitemap><sitemap><loc>"),
                     F.col("origin"), F.lit("/sitemap.xml</loc></sitemap></sitemapindex>"))
    docs = F.array(
        F.struct(F.concat("origin", F.lit("/sitemap.xml")).alias("sitemap_url"), F.lit(200).alias("status_code"),
                 index.alias("body")),
        F.struct(F.concat("origin", F.lit("/sitemap-pages.xml")).alias("sitemap_url"), F.lit(200).alias("status_code"),
                 urlset.alias("body")),
        F.struct(F.concat("origin", F.lit("/sitemap_index.xml")).alias("sitemap_url"), F.lit(404).alias("status_code"),
                 F.lit(None).cast("string").alias("body")),
        F.struct(F.concat("origin", F.lit("/sitemap-missing.xml")).alias("sitemap_url"), F.lit(404).alias("status_code"),
                 F.lit(None).cast("string").alias("body")))
    return per.select(F.explode(docs).alias("d")).select("d.*")


def sites_from_pages(pages: DataFrame, max_pages: int, max_depth: int = 3) -> DataFrame:
    """``sites``: one site per page origin, start URL = origin + '/'."""
    origin = F.regexp_extract(F.col("url"), "^(https?://[^/?#]+)", 1)
    o = pages.select(origin.alias("origin")).filter(F.col("origin") != "").distinct()
    return o.select(F.col("origin").alias("site_id"), F.concat("origin", F.lit("/")).alias("start_url"),
                    F.lit(False).alias("include_subdomains"), F.lit(int(max_pages)).alias("max_pages"),
                    F.lit(int(max_depth)).alias("max_depth"))


def link_graph(pages: DataFrame) -> DataFrame:
    """``d_edges(src_url, link_pos, absolute_url, dst_url)``: page p links
    to pages 2p+1 and 2p+2 (when they exist), mostly on other sites, and
    the r-th page of a site to its pages 2r+1 and 2r+2, by their URLs;
    ``dst_url`` is the normalised target URL."""
    from pyspark.sql import Window

    from lexaudit.functions.urls import with_normalized_url
    origin = F.regexp_extract(F.col("url"), "^(https?://[^/?#]+)", 1)
    p = pages.select("page_id", "url", origin.alias("origin"))
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("origin").orderBy("page_id")) - 1)
    src = p.select(F.col("page_id").alias("src_id"), F.col("url").alias("src_url"), "origin", "r")
    dst = p.select(F.col("page_id").alias("dst_id"), F.col("url").alias("absolute_url"), "origin", F.col("r").alias("dst_r"))
    far = src.select("src_url", F.posexplode(F.array(F.col("src_id") * 2 + 1, F.col("src_id") * 2 + 2))
                     .alias("link_pos", "dst_id")).join(dst, "dst_id").select("src_url", "link_pos", "absolute_url")
    near = src.select("src_url", "origin", F.posexplode(F.array(F.col("r") * 2 + 1, F.col("r") * 2 + 2))
                      .alias("_pos", "dst_r")).join(dst, ["origin", "dst_r"]).select(
        "src_url", (F.col("_pos") + 2).alias("link_pos"), "absolute_url")
    e = with_normalized_url(far.unionByName(near), "absolute_url", True, "dst_url", "_reason")
    return e.select("src_url", F.col("link_pos").cast("int").alias("link_pos"), "absolute_url", "dst_url")


def feed_pages(pages: DataFrame, per_page: int) -> DataFrame:
    """``d_feeds(api_url, page, per_page, status_code, headers, body)`` per
    page origin. ``/wp-json/wp/v2/posts`` answers by length(origin) % 3:
    0 -> 404 with a JSON error code, 1 -> an empty list, 2 -> an HTML page.
    ``/index.php?rest_route=/wp/v2/posts`` lists the origin's page URLs,
    ``per_page`` links per page (objects with id and link, plus one number
    item), and answers 400 ``rest_post_invalid_page_number`` after the last
    page."""
    from lexaudit import schemas
    from lexaudit.operators.common import ordered_row_number
    per_page = int(per_page)
    origin = F.regexp_extract(F.col("url"), "^(https?://[^/?#]+)", 1)
    p = pages.select(origin.alias("origin"), "page_id", "url").filter(F.col("origin") != "")
    per = p.groupBy("origin").agg(F.count(F.lit(1)).alias("_total"))
    k = F.length("origin") % 3
    hdr_none = F.array().cast(schemas.HEADERS)
    wp_json = per.select(
        F.concat("origin", F.lit("/wp-json/wp/v2/posts")).alias("api_url"), F.lit(1).cast("long").alias("page"),
        F.lit(per_page).alias("per_page"),
        F.when(k == 0, F.lit(404)).otherwise(F.lit(200)).alias("status_code"), hdr_none.alias("headers"),
        F.when(k == 0, F.lit('{"code":"rest_no_route","message":"No route"}'))
        .when(k == 1, F.lit("[]")).otherwise(F.lit("<html><body>blog</body></html>")).alias("body"))
    # A feed page holds its own links only: the rank of a link in its origin
    # gives its page, and no row carries the whole list.
    item = F.concat(F.lit('{"id":'), F.col("page_id").cast("string"), F.lit(',"link":"'), F.col("url"), F.lit('"}'))
    ranked = ordered_row_number(p, [F.asc("page_id"), F.asc("url")], ["origin"], "_r")
    chunks = ranked.groupBy("origin", (F.floor((F.col("_r") - 1) / per_page) + 1).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("_r", item.alias("item")))).alias("_items"))
    body = F.concat(F.lit("["), F.array_join(F.array_append(F.col("_items.item"), F.lit("7")), ","), F.lit("]"))
    api_url = F.concat("origin", F.lit("/index.php?rest_route=/wp/v2/posts")).alias("api_url")
    listed = chunks.join(per, "origin").select(
        api_url, "page", F.lit(per_page).alias("per_page"), F.lit(200).alias("status_code"),
        F.array(F.struct(F.lit("X-WP-Total").alias("key"), F.col("_total").cast("string").alias("value"))).alias("headers"),
        body.alias("body"))
    past = per.select(
        api_url, (F.floor((F.col("_total") - 1) / per_page) + 2).alias("page"), F.lit(per_page).alias("per_page"),
        F.lit(400).alias("status_code"), hdr_none.alias("headers"),
        F.lit('{"code":"rest_post_invalid_page_number"}').alias("body"))
    return wp_json.unionByName(listed).unionByName(past)
