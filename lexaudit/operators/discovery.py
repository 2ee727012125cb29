"""Domain discovery from sitemaps and feeds (DSC1-DSC11, DSC14-DSC17).

Several sites are handled at once: every table carries ``site_id`` and the
first-wins and cap rules are evaluated per site. Sitemap index traversal is
level-synchronous: each level is one join of the frontier with the sitemap
table and an anti join with the URLs already seen; FIFO order of the
reference queue equals (level, rank of the parent in its level, loc
position).
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.functions.urls import (first_matching_pattern, py_strip, url_host, with_normalized_url,
                                     with_resolved_url)
from lexaudit.operators.common import dealt_by
from lexaudit.session import written

SITEMAP_SCHEMA = "url array<struct<loc string>>, sitemap array<struct<loc string>>, _corrupt_record string"
_ROOT_RE = "^\\s*(?:<\\?[^>]*\\?>\\s*)?(?:<!--.*?-->\\s*)*(?:<!DOCTYPE[^>]*>\\s*)?<(?:[\\w.-]+:)?([\\w.-]+)"


def _literal_cap(sites: DataFrame) -> int:
    """Largest per-site page cap, as a literal (one tiny aggregate)."""
    v = sites.agg(F.max("max_pages")).first()[0]
    return max(0, int(v or 0))


def sitemap_seeds(sites: DataFrame, robots: DataFrame | None) -> DataFrame:
    """DSC6: ``Sitemap:`` lines (any case, not comments) of a robots body
    with status < 400, resolved against the robots URL, label robots_txt;
    none -> ``sitemap.xml`` and ``sitemap_index.xml`` (default_guess).
    Deduped in order. -> ``(site_id, seed_pos, sitemap_url, discovered_from)``."""
    origin = F.regexp_extract(F.col("start_url"), "^(https?://[^/?#]+)", 1)
    s = sites.select("site_id", origin.alias("origin"))
    none = F.array().cast("array<struct<ln:int,ref:string>>")
    if robots is not None:
        lines = F.transform(F.split(F.coalesce(F.col("body"), F.lit("")), "\\r\\n|\\r|\\n"),
                            lambda line, ln: F.struct(ln.cast("int").alias("ln"), py_strip(line).alias("ref")))
        named = F.filter(lines, lambda x: F.lower(x["ref"]).startswith("sitemap:"))
        named = F.transform(named, lambda x: F.struct(
            x["ln"].alias("ln"), py_strip(F.regexp_extract(x["ref"], "^[^:]*:(.*)$", 1)).alias("ref")))
        found = (robots.filter(F.coalesce(F.col("source_status"), F.lit(999)) < 400)
                 .select("origin", "robots_url", F.filter(named, lambda x: x["ref"] != "").alias("_named")))
        s = s.join(found, "origin", "left")
    else:
        s = s.withColumns({"robots_url": F.lit(None).cast("string"), "_named": none})
    guesses = F.transform(F.array(F.lit("/sitemap.xml"), F.lit("/sitemap_index.xml")),
                          lambda path, ln: F.struct(ln.cast("int").alias("ln"), F.concat("origin", path).alias("ref")))
    guessed = F.size(F.coalesce("_named", none)) == 0
    s = s.select("site_id", F.coalesce("robots_url", F.concat("origin", F.lit("/robots.txt"))).alias("_base"),
                 F.when(guessed, F.lit("default_guess")).otherwise(F.lit("robots_txt")).alias("discovered_from"),
                 F.explode(F.when(guessed, guesses).otherwise(F.col("_named"))).alias("_x"))
    s = s.select("site_id", "_base", "discovered_from", "_x.ln", "_x.ref")
    s = with_resolved_url(s, "_base", "ref", "sitemap_url").filter(F.col("sitemap_url") != "")
    return s.groupBy("site_id", "sitemap_url").agg(
        F.min("ln").alias("seed_pos"), F.min_by("discovered_from", "ln").alias("discovered_from")).select(
        "site_id", "seed_pos", "sitemap_url", "discovered_from")


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """DSC7 + DSC8: ``(sitemap_url, final_url, fetch_status, doc_type, locs)``;
    ``final_url`` is the URL after redirects where ``docs`` has one
    (``follow_redirects``), else the URL itself.
    Status: no row/NULL status -> request_error; >= 400 -> http_<n>; empty
    or malformed XML -> parse_error; root urlset / sitemapindex; another
    root with url/loc -> urlset, with sitemap/loc -> sitemapindex; else
    parse_error. Namespace-blind, loc text stripped, blanks dropped."""
    x = F.from_xml(F.coalesce(F.col("body"), F.lit("")), SITEMAP_SCHEMA,
                   {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    final = F.col("final_url") if "final_url" in docs.columns else F.col("sitemap_url")
    d = docs.select("sitemap_url", final.alias("final_url"), "status_code", "body", x.alias("_x"))
    root = F.regexp_extract(F.coalesce(F.col("body"), F.lit("")), _ROOT_RE, 1)
    url_locs = F.filter(F.transform(F.coalesce(F.col("_x.url"), F.array()), lambda e: py_strip(e["loc"])),
                        lambda v: v.isNotNull() & (v != ""))
    sm_locs = F.filter(F.transform(F.coalesce(F.col("_x.sitemap"), F.array()), lambda e: py_strip(e["loc"])),
                       lambda v: v.isNotNull() & (v != ""))
    corrupt = F.col("_x._corrupt_record").isNotNull() | (py_strip(F.coalesce(F.col("body"), F.lit(""))) == "")
    doc_type = (F.when(corrupt, F.lit(None))
                .when(root == "urlset", F.lit("urlset"))
                .when(root == "sitemapindex", F.lit("sitemapindex"))
                .when(F.size(url_locs) > 0, F.lit("urlset"))
                .when(F.size(sm_locs) > 0, F.lit("sitemapindex")))
    st = F.col("status_code")
    status = (F.when(st.isNull(), F.lit("request_error"))
              .when(st >= 400, F.concat(F.lit("http_"), st.cast("string")))
              .when(doc_type.isNull(), F.lit("parse_error"))
              .otherwise(F.concat(F.lit("ok_"), doc_type)))
    locs = F.when(doc_type == "urlset", url_locs).when(doc_type == "sitemapindex", sm_locs) \
        .otherwise(F.array().cast("array<string>"))
    return d.select("sitemap_url", "final_url", status.alias("fetch_status"),
                    F.when(st < 400, doc_type).alias("doc_type"), F.when(st < 400, locs)
                    .otherwise(F.array().cast("array<string>")).alias("locs"))


_NO_LOCS = "array<string>"


def _with_documents(level: DataFrame, parsed: DataFrame) -> DataFrame:
    return level.join(parsed, "sitemap_url", "left").select(
        "site_id", "level", "key", "sitemap_url", F.coalesce("final_url", "sitemap_url").alias("final_url"), "discovered_from",
        F.coalesce("fetch_status", F.lit("request_error")).alias("fetch_status"), "doc_type",
        F.coalesce("locs", F.array().cast(_NO_LOCS)).alias("locs"))


def _next_level(front: DataFrame, level: int, seen: list[DataFrame]) -> DataFrame:
    """The sitemaps that the indexes of ``front`` name first, in queue order."""
    kids = (front.filter(F.col("fetch_status") == "ok_sitemapindex")
            .select("site_id", F.col("key").alias("_pkey"), F.col("final_url").alias("_parent"),
                    F.posexplode("locs").alias("_lpos", "_loc")))
    kids = with_resolved_url(kids, "_parent", "_loc", "sitemap_url").select(
        "site_id", "_pkey", F.col("_lpos").cast("long").alias("_lpos"), "sitemap_url",
        F.col("_parent").alias("discovered_from")).filter(F.col("sitemap_url") != "")
    for done in seen:
        kids = kids.join(done.select("site_id", "sitemap_url"), ["site_id", "sitemap_url"], "left_anti")
    first = kids.groupBy("site_id", "sitemap_url").agg(
        F.min_by(F.struct("_pkey", "_lpos", "discovered_from"), F.struct("_pkey", "_lpos")).alias("_k"))
    return first.select("site_id", F.lit(level).alias("level"),
                        F.concat(F.col("_k._pkey"), F.array(F.col("_k._lpos"))).alias("key"),
                        "sitemap_url", F.col("_k.discovered_from").alias("discovered_from"))


def traverse_sitemaps(seeds: DataFrame, docs: DataFrame, accept=None) -> DataFrame:
    """DSC9: FIFO traversal of sitemap indexes, each URL once. Returns the
    fetched documents ``(site_id, level, key, sitemap_url, final_url, discovered_from,
    fetch_status, doc_type, locs)``; ``(level, key)`` is the queue order: a
    key holds the seed position and the loc positions down to the document,
    so a level is ordered without a window per site. The loop runs until a
    level brings nothing new (the anti joins end cycles); each level is
    written once.

    ``accept``: called with each written level; it returns the ``site_id`` of
    the sites that have room for more URLs, and only their indexes are
    followed. A queue reaches its cap within the levels up to there, so no
    document before the cap is missed."""
    parsed = written(parse_sitemaps(docs))
    level = seeds.select("site_id", F.lit(0).alias("level"), F.array(F.col("seed_pos").cast("long")).alias("key"),
                         "sitemap_url", "discovered_from")
    levels: list[DataFrame] = []
    for depth in itertools.count(1):
        front = written(_with_documents(level, parsed))
        if depth > 1 and front.isEmpty():
            break
        levels.append(front)
        if accept is not None:
            front = front.join(accept(front), "site_id", "left_semi")
        level = _next_level(front, depth, levels)
    return functools.reduce(DataFrame.unionByName, levels)


class _Acceptance:
    """DSC10 along a sitemap traversal: the accepted URLs of each level are
    written once, and each site's count of them decides whether the next
    level is expanded."""

    def __init__(self, sites: DataFrame, exclude_patterns, exclude_pdf: bool, owned: DataFrame | None):
        self.sites, self.patterns, self.exclude_pdf, self.owned = sites, exclude_patterns, exclude_pdf, owned
        room = sites.select("site_id", "max_pages")
        if owned is not None:
            n = owned.groupBy("site_id").agg(F.count(F.lit(1)).alias("_n"))
            room = room.join(n, "site_id", "left").select(
                "site_id", (F.col("max_pages") - F.coalesce("_n", F.lit(0))).cast("int").alias("max_pages"))
        self.room = written(room)
        self.levels: list[DataFrame] = []

    def __call__(self, front: DataFrame) -> DataFrame:
        locs = (front.filter(F.col("fetch_status") == "ok_urlset")
                .select("site_id", "level", "key", "sitemap_url", F.posexplode("locs").alias("loc_pos", "_loc")))
        locs = with_resolved_url(locs, "sitemap_url", "_loc", "original_url")
        order = F.struct("level", "key", "loc_pos")
        found = accept_candidates(locs, self.sites, self.patterns, self.exclude_pdf).filter("ok")
        for known in [*([] if self.owned is None else [self.owned]), *self.levels]:
            found = found.join(known.select("site_id", "normalized_url"), ["site_id", "normalized_url"], "left_anti")
        firsts = found.groupBy("site_id", "normalized_url").agg(
            F.min_by(F.struct("level", "key", "loc_pos", "original_url", "sitemap_url"), order).alias("_f"))
        self.levels.append(written(firsts.select("site_id", "normalized_url", "_f.*")))
        n = self.accepted().groupBy("site_id").agg(F.count(F.lit(1)).alias("_n"))
        return self.room.join(n, "site_id", "left").filter(
            F.coalesce("_n", F.lit(0)) < F.col("max_pages")).select("site_id")

    def accepted(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, self.levels)


def accept_candidates(cands: DataFrame, sites: DataFrame, exclude_patterns, exclude_pdf: bool = True) -> DataFrame:
    """DSC10 filters on ``(site_id, ..., original_url)``: URL1 ok, no
    exclude pattern, in the site's scope (URL13). Adds ``normalized_url``
    and ``ok``."""
    c = with_normalized_url(cands, "original_url", exclude_pdf, "normalized_url", "_reason")
    pat = first_matching_pattern(F.col("normalized_url"), exclude_patterns)
    root = sites.select("site_id", url_host(F.col("start_url")).alias("_root"),
                        F.col("include_subdomains").alias("_sub"))
    c = c.join(root, "site_id", "left")
    from lexaudit.functions.urls import in_scope
    host = url_host(F.col("normalized_url"))
    ok = F.col("_reason").isNull() & pat.isNull() & (host != "") & F.coalesce(in_scope(host, F.col("_root"), F.col("_sub")), F.lit(False))
    return c.withColumn("ok", ok).drop("_reason", "_root", "_sub")


def sitemap_targets(seeds: DataFrame, docs: DataFrame, sites: DataFrame, exclude_patterns, exclude_pdf: bool = True,
                    owned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """DSC9 + DSC10: URLs of the fetched urlsets in queue order; first wins;
    cap ``max_pages`` per site (minus URLs owned by an earlier source);
    returns ``(targets, sitemap_sources)`` where sources are the documents
    fetched before the cap stopped the queue."""
    acceptance = _Acceptance(sites, exclude_patterns, exclude_pdf, owned)
    docs = traverse_sitemaps(seeds, docs, acceptance).select(
        "site_id", "level", "key", "sitemap_url", "discovered_from", "fetch_status", F.size("locs").alias("url_count"))
    cap = acceptance.room
    w = Window.partitionBy("site_id").orderBy("level", "key", "loc_pos")
    t = acceptance.accepted().withColumn("_n", F.row_number().over(w))
    # The literal bound lets Spark cut each site to L rows per map task
    # before the shuffle (WindowGroupLimit); the column test is exact.
    t = t.filter(F.col("_n") <= _literal_cap(sites)).join(cap, "site_id").filter(F.col("_n") <= F.col("max_pages"))
    targets = written(t.select(
        "site_id", "original_url", "normalized_url", F.lit("sitemap").alias("source_type"),
        F.col("sitemap_url").alias("discovered_from"), F.lit(0).alias("depth"), F.col("level").alias("_level"),
        F.col("key").alias("_key"), F.col("loc_pos").alias("_loc_pos")))
    # A document is fetched while fewer than the cap are accepted before it:
    # one ordered pass per site over document and target events (a site has
    # at most max_pages targets, so the window is bounded).
    ev = (docs.select("site_id", "level", "key", F.lit(-1).alias("_sub"), F.lit(0).alias("_t"),
                      "sitemap_url", "discovered_from", "fetch_status", "url_count")
          .unionByName(targets.select("site_id", F.col("_level").alias("level"), F.col("_key").alias("key"),
                                      F.col("_loc_pos").alias("_sub"), F.lit(1).alias("_t"),
                                      F.lit(None).cast("string").alias("sitemap_url"),
                                      F.lit(None).cast("string").alias("discovered_from"),
                                      F.lit(None).cast("string").alias("fetch_status"),
                                      F.lit(None).cast("int").alias("url_count"))))
    we = Window.partitionBy("site_id").orderBy("level", "key", "_sub").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("_before", F.sum("_t").over(we)).join(cap, "site_id")
    sources = ev.filter((F.col("_t") == 0) & (F.col("_before") < F.col("max_pages"))).select(
        "site_id", "level", "key", "sitemap_url", "discovered_from", "fetch_status",
        F.col("url_count").cast("int").alias("url_count"))
    # Insertion order: source, then queue position.
    at = F.concat(F.array(F.lit(2).cast("long"), F.col("_level").cast("long")), "_key", F.array(F.col("_loc_pos").cast("long")))
    return targets.withColumn("_pos", at).drop("_level", "_key", "_loc_pos"), sources


# ------------------------------------------------------------- feeds ----
# Posts asked for at once where no cap asks for fewer (the most the API gives).
FEED_PAGE_SIZE = 100


def feed_candidates(sites: DataFrame) -> DataFrame:
    """DSC1: per site, base prefixes = root and the first 1..3 path segments
    of the start URL; two endpoints each; deduped in order.
    -> ``(site_id, candidate_pos, api_url, discovered_from)``."""
    from lexaudit.functions.urls import with_normalized_url
    s = with_normalized_url(sites.select("site_id", "start_url"), "start_url", True, "_n", "_r")
    origin = F.regexp_extract(F.col("_n"), "^(https?://[^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_extract(F.col("_n"), "^https?://[^/?#]+([^?#]*)", 1), "^/+", "")
    segs = F.filter(F.split(path, "/"), lambda x: x != "")
    s = s.select("site_id", origin.alias("origin"), segs.alias("_segs"))
    s = written(s)

    def endpoints(k: F.Column) -> F.Column:
        prefix = F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice("_segs", 1, k), "/")))
        base = F.regexp_replace(F.concat("origin", prefix), "/+$", "")
        label = F.concat(F.lit("base:"), F.when(prefix == "", F.lit("/")).otherwise(prefix))
        return F.array(F.struct(F.concat(base, F.lit("/wp-json/wp/v2/posts")).alias("api_url"), label.alias("discovered_from")),
                       F.struct(F.concat(base, F.lit("/index.php?rest_route=/wp/v2/posts")).alias("api_url"),
                                F.concat(label, F.lit(":rest_route")).alias("discovered_from")))

    # At most eight endpoints a site: the first of each URL, within the row.
    all_ = F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.size("_segs"), F.lit(3))), endpoints))
    s = s.select("site_id", all_.alias("_all"))
    first = F.filter("_all", lambda e, i: F.array_position(F.transform("_all", lambda x: x["api_url"]), e["api_url"]) == i + 1)
    return s.select("site_id", F.posexplode(first).alias("_p", "_e")).select(
        "site_id", (F.col("_p") + 1).alias("candidate_pos"), "_e.api_url", "_e.discovered_from")


def feed_page_status(pages: DataFrame) -> DataFrame:
    """DSC2 per fetched feed page ``(api_url, page, per_page, status_code,
    headers, body)`` -> adds ``page_status`` (ok, stop_invalid_page, or an
    error status), ``n_items`` and ``links`` (non-empty stripped ``link`` of
    object items, in order)."""
    v = F.try_parse_json(F.col("body"))
    p = pages.withColumn("_v", v).withColumn("_schema", F.schema_of_variant(F.col("_v")))
    code = py_strip(F.coalesce(F.try_variant_get(F.col("_v"), "$.code", "string"), F.lit("")))
    is_obj = F.col("_schema").startswith("OBJECT")
    is_arr = F.col("_schema").startswith("ARRAY")
    obj_code = F.when(is_obj & (code != ""), code)
    st = F.col("status_code")
    has_wp_hdr = F.exists(F.coalesce(F.col("headers"), F.array()), lambda h: F.lower(h["key"]).startswith("x-wp-"))
    # Items of array bodies, in order (mixed item types stay VARIANT); a page
    # has at most ``per_page`` of them.
    p = p.withColumn("_items", F.when(is_arr, F.transform(
        F.try_variant_get(F.col("_v"), "$", "array<variant>"), lambda v: F.struct(
            F.schema_of_variant(v).alias("schema"),
            py_strip(F.coalesce(F.try_variant_get(v, "$.link", "string"), F.lit(""))).alias("link")))))
    objects = F.filter("_items", lambda x: x["schema"].startswith("OBJECT"))
    p = p.withColumns({
        "n_items": F.coalesce(F.size("_items"), F.lit(0)), "_first_obj": F.try_element_at(objects, F.lit(1))["schema"],
        "links": F.transform(F.filter(objects, lambda x: x["link"] != ""), lambda x: x["link"])})
    p = p.withColumn("n_items", F.greatest("n_items", F.lit(0)))
    looks_wp = has_wp_hdr | F.coalesce(F.col("_first_obj").rlike("[<,]\\s*(link|id|slug):"), F.lit(False))
    status = (F.when(st.isNull(), F.lit("request_error"))
              .when((st <= 400) & (F.col("page") > 1) & (obj_code == "rest_post_invalid_page_number"),
                    F.lit("stop_invalid_page"))
              .when(st >= 400, F.coalesce(F.concat(F.lit("rest_error:"), obj_code),
                                          F.concat(F.lit("http_"), st.cast("string"))))
              .when(F.col("_v").isNull(), F.lit("non_json_response"))
              .when(is_obj, F.coalesce(F.concat(F.lit("rest_error:"), obj_code), F.lit("unexpected_json_object")))
              .when(~is_arr, F.lit("unexpected_json_type"))
              .when(~looks_wp, F.lit("non_wordpress_response"))
              .otherwise(F.lit("ok")))
    total = py_strip(F.coalesce(F.try_element_at(F.filter(F.coalesce(F.col("headers"), F.array()),
                                                       lambda h: F.lower(h["key"]) == "x-wp-totalpages"),
                                              F.lit(1))["value"], F.lit(""))).try_cast("int")
    return p.select("api_url", "page", "per_page", status.alias("page_status"),
                    F.coalesce(F.col("n_items"), F.lit(0)).alias("n_items"),
                    F.coalesce(F.col("links"), F.array().cast("array<string>")).alias("links"),
                    F.when(total > 0, total).alias("total_pages"))


def feed_results(candidates: DataFrame, pages: DataFrame, max_urls: int | None,
                 sites: DataFrame | None = None) -> DataFrame:
    """DSC3 + DSC5: per candidate, pages in order until the first terminal
    page (error, invalid-page stop, empty list, last total page, short page,
    or enough links: the site's ``max_pages`` where ``sites`` is given, else
    ``max_urls``); an error page fails the whole candidate, and a page that
    could not be requested leaves no links of earlier pages. Candidates
    are tried in order; the first ok one with links ends the search (later
    ones are not fetched). -> ``(site_id, candidate_pos, api_url,
    discovered_from, fetch_status, url_count, page_count, post_urls,
    fetched, chosen)``.

    ``max_urls`` None: no cap. A feed may then have any number of links, so
    no row gathers them: instead of ``post_urls`` the results name the
    ``last_page`` read (NULL: all), and ``feed_targets`` takes the links from
    the pages. ``pages`` may be their ``feed_page_status`` already."""
    st = pages if "page_status" in pages.columns else feed_page_status(pages)
    if max_urls is None:
        return _whole_feed_results(candidates, st)
    c = candidates.join(st, "api_url", "left").withColumn("_cap", F.lit(int(max_urls)))
    if sites is not None:
        c = c.drop("_cap").join(sites.select("site_id", F.col("max_pages").alias("_cap")), "site_id", "left") \
            .withColumn("_cap", F.coalesce("_cap", F.lit(int(max_urls))))
    w = Window.partitionBy("site_id", "api_url").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_cum", F.sum(F.when(F.col("page_status") == "ok", F.size("links")).otherwise(0)).over(w))
    ok = F.col("page_status") == "ok"
    stop_here = _ends_feed() | (F.col("_cum") >= F.col("_cap"))
    c = c.withColumn("_stop", F.min(F.when(stop_here, F.col("page"))).over(
        Window.partitionBy("site_id", "api_url")))
    used = c.filter(F.col("page").isNull() | F.col("_stop").isNull() | (F.col("page") <= F.col("_stop")))
    g = used.groupBy("site_id", "candidate_pos", "api_url", "discovered_from").agg(
        _feed_error().alias("_err"), F.count_if(ok).alias("page_count"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("page", "links")))),
                              lambda x: x["links"])).alias("_urls"),
        F.max("page").alias("_max_page"), F.max("_cap").alias("_cap"))
    urls = F.when(F.col("_err") == "request_error", F.array().cast("array<string>")) \
        .otherwise(F.slice(F.col("_urls"), F.lit(1), F.greatest("_cap", F.lit(0))))
    return _with_choice(g.select(
        "site_id", "candidate_pos", "api_url", "discovered_from", _feed_status(F.size("_urls")).alias("fetch_status"),
        F.size(urls).alias("url_count"), "page_count", urls.alias("post_urls")))


def _whole_feed_results(candidates: DataFrame, st: DataFrame) -> DataFrame:
    """``feed_results`` without a cap. Where a feed ends needs no running sum
    then: its pages, without their links, are aggregated by feed, and a
    candidate meets one row of its feed."""
    st = st.select("api_url", "page", "page_status", F.size("links").alias("_links"), _ends_feed().alias("_end"))
    last = st.groupBy("api_url").agg(F.min(F.when(F.col("_end"), F.col("page"))).alias("last_page"))
    used = st.join(last, "api_url").filter(
        F.col("page").isNull() | F.col("last_page").isNull() | (F.col("page") <= F.col("last_page")))
    ok = F.col("page_status") == "ok"
    g = used.groupBy("api_url", "last_page").agg(
        _feed_error().alias("_err"), F.count_if(ok).alias("page_count"),
        F.sum(F.when(ok, F.col("_links")).otherwise(0)).alias("_n"), F.max("page").alias("_max_page"))
    g = candidates.join(g, "api_url", "left").withColumns({
        "page_count": F.coalesce("page_count", F.lit(0)), "_n": F.coalesce("_n", F.lit(0))})
    return _with_choice(g.select(
        "site_id", "candidate_pos", "api_url", "discovered_from", _feed_status(F.col("_n")).alias("fetch_status"),
        F.when(F.col("_err") == "request_error", F.lit(0)).otherwise(F.col("_n")).alias("url_count"),
        "page_count", "last_page"))


def _ends_feed() -> F.Column:
    """A page after which no other is asked for, whatever the cap."""
    return ((F.col("page_status") != "ok")
            | (F.col("n_items") == 0)
            | (F.col("total_pages").isNotNull() & (F.col("page") >= F.col("total_pages")))
            | (F.col("n_items") < F.col("per_page")))


def _feed_error() -> F.Column:
    """Aggregate: status of the first error page."""
    return F.min_by(F.col("page_status"), F.when(F.col("page_status").isin("ok", "stop_invalid_page"),
                                                 F.lit(None)).otherwise(F.col("page")))


def _feed_status(n_urls: F.Column) -> F.Column:
    return (F.when(F.col("_max_page").isNull(), F.lit("request_error"))
            .when(F.col("_err").isNotNull(), F.col("_err"))
            .when(n_urls > 0, F.lit("ok_posts")).otherwise(F.lit("ok_empty")))


def _with_choice(g: DataFrame) -> DataFrame:
    """Adds ``fetched`` and ``chosen``: the first ok candidate with links."""
    wins = F.col("fetch_status").startswith("ok") & (F.col("url_count") > 0)
    g = g.withColumn("_win_pos", F.min(F.when(wins, F.col("candidate_pos"))).over(Window.partitionBy("site_id")))
    return g.withColumn("fetched", F.col("_win_pos").isNull() | (F.col("candidate_pos") <= F.col("_win_pos"))) \
        .withColumn("chosen", F.coalesce(F.col("candidate_pos") == F.col("_win_pos"), F.lit(False))).drop("_win_pos")


def feed_targets(results: DataFrame, sites: DataFrame, exclude_patterns, exclude_pdf: bool = True,
                 pages: DataFrame | None = None) -> DataFrame:
    """DSC4 + DSC10 for the chosen feed: links resolved against ``origin +
    '/'``, filtered, first wins, capped by ``max_pages``. Of results without
    a cap ``pages``, the ``feed_page_status`` they were made of, gives the
    links up to ``last_page``, and none is cut."""
    origin = F.regexp_extract(F.col("start_url"), "^(https?://[^/?#]+)", 1)
    ch = results.filter("chosen").join(sites.select("site_id", origin.alias("_origin"), "max_pages"), "site_id")
    if pages is not None:
        # One row a site: written, its size is known to the join with the pages.
        # Page rows are compact, so they are dealt for the URL rules of their links.
        ch = written(ch.select("site_id", "api_url", "_origin", "last_page"))
        read = pages.filter(F.col("page_status") == "ok").select("api_url", "page", "links").join(ch, "api_url")
        read = dealt_by(read.filter(F.col("last_page").isNull() | (F.col("page") <= F.col("last_page"))), "api_url", "page")
        links = read.select("site_id", "api_url", "_origin", "page", F.posexplode("links").alias("link_pos", "_l"))
        acc = _feed_acceptance(links, sites, exclude_patterns, exclude_pdf)
        firsts = acc.groupBy("site_id", "normalized_url").agg(
            F.min_by(F.struct("page", "link_pos", "original_url", "api_url"),
                     F.when(F.col("ok"), F.struct("page", "link_pos"))).alias("_f"))
        return _feed_rows(firsts.filter(F.col("_f").isNotNull()), F.col("_f.page"), F.col("_f.link_pos"))
    links = ch.select("site_id", "api_url", "max_pages", "_origin", F.posexplode("post_urls").alias("link_pos", "_l"))
    acc = _feed_acceptance(links, sites, exclude_patterns, exclude_pdf)
    firsts = acc.groupBy("site_id", "normalized_url").agg(
        F.min_by(F.struct("link_pos", "original_url", "api_url", "max_pages"), F.when(F.col("ok"), F.col("link_pos")))
        .alias("_f"))
    firsts = firsts.filter(F.col("_f").isNotNull())
    w = Window.partitionBy("site_id").orderBy("_f.link_pos")
    lim = _literal_cap(sites)
    t = firsts.withColumn("_n", F.row_number().over(w)).filter(
        (F.col("_n") <= lim) & (F.col("_n") <= F.col("_f.max_pages")))
    return _feed_rows(t, F.col("_f.link_pos"))


def _feed_acceptance(links: DataFrame, sites: DataFrame, exclude_patterns, exclude_pdf: bool) -> DataFrame:
    links = links.withColumn("_base", F.concat("_origin", F.lit("/"))).withColumn("_l", py_strip(F.col("_l")))
    links = with_resolved_url(links, "_base", "_l", "original_url")
    return accept_candidates(links, sites, exclude_patterns, exclude_pdf)


def _feed_rows(firsts: DataFrame, *place: F.Column) -> DataFrame:
    at = F.array(F.lit(1).cast("long"), *(p.cast("long") for p in place))
    return firsts.select("site_id", F.col("_f.original_url").alias("original_url"), "normalized_url",
                         F.lit("wp_rest_api").alias("source_type"), F.col("_f.api_url").alias("discovered_from"),
                         F.lit(0).alias("depth"), at.alias("_pos"))


# ------------------------------------------------------ whole collection ----
def collect_domain(sites: DataFrame, settings, *, feed_pages: DataFrame | None = None,
                   robots: DataFrame | None = None, sitemap_docs: DataFrame | None = None,
                   edges: DataFrame | None = None, allowed: DataFrame | None = None) -> dict[str, DataFrame]:
    """API3 / DSC1-DSC17 for many sites at once: feed, then sitemaps, then
    the root fallback and the BFS supplement; the first source that adds a
    URL owns it, and every stage respects the per-site cap and depth.
    ``allowed``: robots decisions for the walk, ``(normalized_url, allowed)``;
    a target that the walk finds blocked is dropped (DSC15).

    Returns ``targets``, ``discovered``, ``sitemap_sources``,
    ``wp_api_sources`` and a per-site ``summary`` (DSC17)."""
    from lexaudit.functions.urls import with_normalized_url
    from lexaudit.operators.frontier import bfs
    s = settings
    cols = ["site_id", "original_url", "normalized_url", "source_type", "discovered_from", "depth", "_pos"]
    spark = sites.sparkSession
    sites = written(sites)
    empty_targets = spark.createDataFrame([], "site_id string, original_url string, normalized_url string, "
                                              "source_type string, discovered_from string, depth int, _pos array<long>")
    targets = empty_targets
    wp_sources = None
    if s.prefer_wordpress_api and feed_pages is not None:
        # Stage outputs are small per-site tables; each is checkpointed so
        # the next stage starts from a short lineage (and survives executor
        # loss without recomputing the earlier stages).
        res = written(feed_results(feed_candidates(sites), feed_pages, int(s.max_pages), sites))
        wp_sources = res.filter("fetched").select("site_id", "api_url", "discovered_from", "fetch_status",
                                                  "url_count", "page_count")
        targets = written(feed_targets(res, sites, s.exclude_url_patterns, s.exclude_pdf).select(*cols))
    sm_sources = None
    if sitemap_docs is not None:
        sm_t, sm_sources = sitemap_targets(sitemap_seeds(sites, robots), sitemap_docs, sites, s.exclude_url_patterns,
                                           s.exclude_pdf, owned=targets.select("site_id", "normalized_url"))
        sm_sources = written(sm_sources)
        targets = written(targets.unionByName(sm_t.select(*cols)))
    # DSC11: root fallback when below the cap and the start URL is no target.
    start = written(with_normalized_url(sites.select("site_id", "start_url", "max_pages"), "start_url", s.exclude_pdf,
                                        "normalized_url", "_r"))
    n = targets.groupBy("site_id").agg(F.count(F.lit(1)).alias("_n"))
    fb = (start.join(n, "site_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
          .join(targets.select("site_id", "normalized_url"), ["site_id", "normalized_url"], "left_anti")
          .filter((F.col("_n") < F.col("max_pages")) & (F.col("normalized_url") != "")))
    targets = written(targets.unionByName(fb.select(
        "site_id", F.col("start_url").alias("original_url"), "normalized_url",
        F.lit("fallback_root").alias("source_type"), F.col("start_url").alias("discovered_from"),
        F.lit(0).alias("depth"), F.array(F.lit(3).cast("long")).alias("_pos"))))
    discovered = targets.select("site_id", "normalized_url", "source_type", "discovered_from", "depth")
    if edges is not None:
        # DSC14 seeds: start URL first, then targets in insertion order.
        start_url = start.select("site_id", F.col("normalized_url").alias("_start"))
        seeds = targets.join(start_url, "site_id").withColumn(
            "_first", F.col("normalized_url").eqNullSafe(F.col("_start")).cast("int"))
        capped = sites.select("site_id", "max_pages")
        under = targets.groupBy("site_id").agg(F.count(F.lit(1)).alias("_n")).join(capped, "site_id") \
            .filter(F.col("_n") < F.col("max_pages")).select("site_id")
        seeds = seeds.join(under, "site_id", "left_semi")
        w = Window.partitionBy("site_id").orderBy(F.desc("_first"), "_pos")
        seeds = seeds.select("site_id", F.row_number().over(w).cast("long").alias("seed_rank"), "normalized_url")
        bt, bd = bfs(edges, seeds, int(s.max_depth), max_pages=int(s.max_pages), allowed=allowed, sites=sites,
                     exclude_patterns=s.exclude_url_patterns)
        if allowed is not None:
            blocked = allowed.filter(~F.col("allowed")).select("normalized_url")
            gone = seeds.join(blocked, "normalized_url", "left_semi").select("site_id", "normalized_url")
            targets = written(targets.join(gone, ["site_id", "normalized_url"], "left_anti"))
            discovered = targets.select("site_id", "normalized_url", "source_type", "discovered_from", "depth")
        targets = targets.drop("_pos")
        bt = bt.join(targets.select("site_id", "normalized_url"), ["site_id", "normalized_url"], "left_anti")
        targets = targets.unionByName(bt.select("site_id", F.col("normalized_url").alias("original_url"),
                                                "normalized_url", F.lit("bfs").alias("source_type"),
                                                "discovered_from", "depth"))
        bd = bd.filter(F.col("depth") > 0).join(discovered.select("site_id", "normalized_url"),
                                                ["site_id", "normalized_url"], "left_anti")
        discovered = discovered.unionByName(bd.select("site_id", "normalized_url", F.lit("bfs").alias("source_type"),
                                                      "discovered_from", "depth"))
    summary = (targets.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(F.col("source_type") == "wp_rest_api").alias("wp_api_targets"),
        F.count_if(F.col("source_type") == "sitemap").alias("sitemap_targets"),
        F.count_if(F.col("source_type") == "bfs").alias("bfs_targets"),
        F.max((F.col("source_type") == "fallback_root").cast("int")).cast("boolean").alias("fallback_used"))
        .join(discovered.groupBy("site_id").agg(F.count(F.lit(1)).alias("discovered")), "site_id", "left"))
    # Sites without a target count as well.
    summary = sites.select("site_id").join(summary, "site_id", "left").na.fill(
        0, ["targets", "wp_api_targets", "sitemap_targets", "bfs_targets", "discovered"]).na.fill(False, ["fallback_used"])
    out = {"targets": targets.drop("_pos"), "discovered": discovered, "summary": summary}
    if sm_sources is not None:
        out["sitemap_sources"] = sm_sources
        summary = summary.join(sm_sources.groupBy("site_id").agg(F.count(F.lit(1)).alias("sitemaps_probed")),
                               "site_id", "left")
    if wp_sources is not None:
        out["wp_api_sources"] = wp_sources
        summary = summary.join(wp_sources.groupBy("site_id").agg(
            F.count(F.lit(1)).alias("wp_api_probed"),
            F.max(F.col("fetch_status").startswith("ok").cast("int")).cast("boolean").alias("wp_api_used")),
            "site_id", "left")
    out["summary"] = summary
    return out
