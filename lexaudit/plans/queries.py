"""Registered queries: each takes ``(spark, sf_dir)`` and returns a
DataFrame over the whole driver tables. ``oracle.py`` holds the DuckDB SQL
with the same column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaudit.functions import urls as U
from lexaudit.operators import keywords as K
from lexaudit.operators import urls as UO
from lexaudit.operators import audit as A
from lexaudit.operators import discovery as DS
from lexaudit.operators import fetchlog as FL
from lexaudit.operators import html as H
from lexaudit.operators import robots as R
from lexaudit.operators.tokens import forced_matches, scan_keywords, script_tokens
from lexaudit.session import written
from lexaudit.settings import Settings
from lexaudit.sources import derived as D
from lexaudit.sources.readers import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]

# Settings of the registered queries (fixed so that the oracle SQL can
# spell out the same values).
USER_STOPWORDS_TEXT = "the, and、of，in\nto"
URL_EXCLUDE_PATTERNS = ("/tag/", "/category/", "/search", "/de/", "/fr/1")
URL_CAP_PER_SITE = 3


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "text")


def q_keyword_raw(spark: SparkSession, sf: str) -> DataFrame:
    """AGG2 + AGG6 on documents (TOK1b, TOK2, TOK3, TOK5 via noun runs, TOK8)."""
    s = Settings()
    occ = K.noun_occurrences(_docs(spark, sf), "text", compound_mode=s.compound_mode)
    return K.rank_frequency(K.raw_frequency(K.count_occurrences(occ), s))


def q_keyword_final(spark: SparkSession, sf: str) -> DataFrame:
    """AGG3 + AGG6: raw minus user stopwords parsed from text (TOK9, TOK10)."""
    s = Settings(additional_stopwords_text=USER_STOPWORDS_TEXT)
    occ = K.noun_occurrences(_docs(spark, sf), "text", compound_mode=s.compound_mode)
    return K.rank_frequency(K.final_frequency(K.raw_frequency(K.count_occurrences(occ), s), s))


def q_keyword_topn(spark: SparkSession, sf: str) -> DataFrame:
    """AGG7: top-N words with weight (the top-N cut is the feature)."""
    s = Settings()
    occ = K.noun_occurrences(_docs(spark, sf), "text", compound_mode=s.compound_mode)
    return K.top_n(K.raw_frequency(K.count_occurrences(occ), s), s.top_n_wordcloud)


def q_script_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """TOK1b: per document, token counts by part of speech."""
    toks = script_tokens(_docs(spark, sf), "doc_id", "text")
    return toks.groupBy(F.col("doc_key").cast("long").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if(F.col("primary_pos") == "名詞").alias("n_nouns"),
        F.count_if(F.col("subtype") == "数").alias("n_numbers"),
        F.count_if(F.col("subtype") == "空白").alias("n_spaces"),
        F.count_if(F.col("primary_pos") == "記号").alias("n_signs"),
        F.max("pos").cast("long").alias("last_pos"))


def q_url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """URL1-URL5 on page URLs and altered copies."""
    d = D.url_variants(read_table(spark, sf, "pages").select("page_id", "url"))
    n = U.with_normalized_url(d, "original_url")
    return n.select("input_pos", "original_url", "normalized_url", "skip_reason")


def q_url_classify(spark: SparkSession, sf: str) -> DataFrame:
    """URL6, URL8, URL10 (no cap): targets and skipped in one table."""
    d = D.url_variants(read_table(spark, sf, "pages").select("page_id", "url"))
    c = UO.classify_urls(d, exclude_patterns=URL_EXCLUDE_PATTERNS, max_urls=None)
    return c.select("input_pos", "original_url", "normalized_url", "source_type", "skip_reason")


def q_url_cap(spark: SparkSession, sf: str) -> DataFrame:
    """URL9: per-site cap (site = registered domain of the page URL)."""
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    pages = pages.withColumn("site_id", U.registered_domain(U.url_host(F.col("url"))))
    d = D.url_variants(pages)
    c = UO.classify_urls(d, exclude_patterns=(), max_urls=URL_CAP_PER_SITE)
    return c.select("site_id", "input_pos", "normalized_url", "skip_reason")


def q_url_registered_domain(spark: SparkSession, sf: str) -> DataFrame:
    """URL11, URL12: origin, host and registered domain per page URL."""
    p = read_table(spark, sf, "pages").select("page_id", "url")
    host = U.url_host(F.col("url"))
    return p.select("page_id", U.url_origin(F.col("url")).alias("origin"), host.alias("host"),
                    U.registered_domain(host).alias("registered_domain"))


# Suffix rules of url_suffix_domain.
SUFFIX_RULES = ("com", "net", "org", "*.example.net", "!blog.tionsh.example.net", "example.org")


def q_url_suffix_domain(spark: SparkSession, sf: str) -> DataFrame:
    """URL12 with a suffix table: registered domain per page URL by listed,
    wildcard and exception rules, the fallback rule where none matches."""
    from lexaudit.operators.suffixes import suffix_rules, with_registered_domain
    p = read_table(spark, sf, "pages").select("page_id", U.url_host(F.col("url")).alias("host"))
    rules = suffix_rules(spark.createDataFrame([(r,) for r in SUFFIX_RULES], "value string"))
    return with_registered_domain(p, "host", "registered_domain", rules)


def q_url_scope(spark: SparkSession, sf: str) -> DataFrame:
    """URL13: per registered domain, how many page URLs are in scope of the
    domain's first page host, with and without subdomains."""
    p = read_table(spark, sf, "pages").select("page_id", "url")
    host = U.url_host(F.col("url"))
    p = p.select("page_id", host.alias("host"), U.registered_domain(host).alias("rd"))
    roots = p.groupBy("rd").agg(F.min_by("host", "page_id").alias("root_host"))
    j = p.join(roots, "rd")
    return j.groupBy("rd").agg(
        F.first("root_host").alias("root_host"),
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(U.in_scope(F.col("host"), F.col("root_host"), F.lit(False))).alias("n_same_host"),
        F.count_if(U.in_scope(F.col("host"), F.col("root_host"), F.lit(True))).alias("n_same_domain"))


def _pages(spark: SparkSession, sf: str, cols=("page_id", "url", "html")) -> DataFrame:
    return read_table(spark, sf, "pages", key="page_id").select(*cols)


def q_container_text(spark: SparkSession, sf: str) -> DataFrame:
    """EXT0 + EXT5 + EXT8: fallback container text per page."""
    fb = H.page_texts(_pages(spark, sf, ("page_id", "html")), "page_id")
    return fb.select(F.col("page_key").alias("page_id"), F.col("fallback_text").alias("text"),
                     F.length("fallback_text").alias("chars"))


def q_block_text(spark: SparkSession, sf: str) -> DataFrame:
    """EXT6: block-scored primary text per page."""
    pages = H.with_parts(_pages(spark, sf, ("page_id", "html")))
    pt = pages.filter(F.col("parts.primary").isNotNull()).select("page_id", H.primary_text().alias("primary_text"))
    return pt.select("page_id", F.length("primary_text").alias("chars"),
                     F.size(F.split("primary_text", "\n")).alias("lines"))


def q_title_text(spark: SparkSession, sf: str) -> DataFrame:
    """EXT3 + EXT9: cleaned title and the title-prefixed container text."""
    t = H.with_parts(_pages(spark, sf, ("page_id", "html"))).select(
        "page_id", F.coalesce(H.title_text(), F.lit("")).alias("title"),
        F.coalesce(H.fallback_text(), F.lit("")).alias("body"))
    text, added = A.prepend_title(F.col("title"), F.col("body"))
    return t.select("page_id", "title", added.alias("title_added"), F.length(text).alias("chars"))


def q_noindex(spark: SparkSession, sf: str) -> DataFrame:
    """EXT1 + EXT2: noindex status, source and value per derived page."""
    fp = D.fetched_pages(_pages(spark, sf))
    a = A.analyze_pages(fp, Settings())
    return a.select(F.col("page_key").alias("page_id"), "noindex_status", "noindex_source", "noindex_value")


def q_url_audit(spark: SparkSession, sf: str) -> DataFrame:
    """EXT4, EXT10-EXT12: audit columns per derived page."""
    fp = D.fetched_pages(_pages(spark, sf))
    a = A.analyze_pages(fp, Settings())
    return a.select(F.col("page_key").alias("page_id"), "url", "status_code", "robots_txt", "noindex_status",
                    "content_type", "excluded_reason", "included_in_analysis")


def q_page_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: pages -> EXT0 -> EXT5 -> EXT8 -> tokens -> counts -> rank."""
    fb = H.page_texts(_pages(spark, sf, ("page_id", "html")), "page_id")
    s = Settings()
    occ = K.noun_occurrences(fb, "fallback_text", compound_mode=s.compound_mode)
    return K.rank_frequency(K.raw_frequency(K.count_occurrences(occ), s))


def q_keywords_per_site(spark: SparkSession, sf: str) -> DataFrame:
    """AGG2 + AGG6 keyed by site (registered domain of the page URL)."""
    pages = _pages(spark, sf).withColumn("site_id", U.registered_domain(U.url_host(F.col("url"))))
    fb = H.page_texts(pages, "page_id", keep=["site_id"])
    s = Settings()
    occ = K.noun_occurrences(fb, "fallback_text", ["site_id"], s.compound_mode)
    counts = K.raw_frequency(K.count_occurrences(occ, ["site_id"]), s)
    return K.rank_frequency(counts, ["site_id"])


def q_link_edges(spark: SparkSession, sf: str) -> DataFrame:
    """DSC12: ``<a href>`` in page order, resolved against the page URL,
    normalised, first per normalised URL."""
    from lexaudit.operators.frontier import link_edges
    pages = _pages(spark, sf)
    e = link_edges(pages, "page_id", "url", "html")
    return e.select(F.col("src_key").alias("page_id"), "link_pos", "absolute_url", "dst_url")


def q_url_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """URL14 on every ``<a href>`` and on fixed relative forms per page."""
    pages = _pages(spark, sf)
    hrefs = H.anchor_hrefs(H.html_tokens(pages.select("page_id", "html"), "page_id", "html"))
    extra = pages.select(F.col("page_id").alias("page_key"), F.posexplode(F.array(
        *[F.lit(x) for x in RESOLVE_FORMS])).alias("link_pos", "href")).select(
        "page_key", (F.col("link_pos") - 100).alias("link_pos"), "href")
    allh = hrefs.unionByName(extra).join(pages.select(F.col("page_id").alias("page_key"), "url"), "page_key")
    return U.with_resolved_url(allh, "url", "href", "resolved").select(
        F.col("page_key").alias("page_id"), "link_pos", "href", "resolved")


# Fixed relative forms resolved against every page URL in ``url_resolve``.
RESOLVE_FORMS = ("", "#frag", "?q=1", "//cdn.example.com/x", "/a/./b/../c", "d/e", "../f", "./g/",
                 "https://other.example.com/p", "mailto:x@example.com", "..", ".")


def q_robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    """ROB1 + ROB2: parsed rule table of the derived robots bodies."""
    b = D.robots_bodies(_pages(spark, sf, ("page_id", "url")))
    r = R.robots_rules(b)
    return r.select("origin", "entry", F.array_join("agents", ",").alias("agents"), "is_default",
                    "entry_rank", "seq", "allow", "path")


def q_robots_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """ROB1-ROB5 on every page URL."""
    pages = _pages(spark, sf, ("page_id", "url"))
    d = R.robots_decisions(pages, D.robots_bodies(pages), Settings().user_agent)
    return d.select("url", "origin", "allowed", "robots_decision", "robots_url", "source_status")


def q_fetch_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """FET1-FET8, FET11 on the derived attempt log."""
    pages = _pages(spark, sf)
    o = FL.outcome_label(FL.fetch_outcomes(D.fetch_attempts(pages), Settings().retry_count))
    return o.select("target_url", "final_url", "status_code", "content_type", "error_kind", "outcome",
                    "content_length", "redirect_happened", "elapsed_sec", "attempts_used",
                    "retry_after_sec", F.length("html").alias("html_chars"),
                    F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"))


def q_fetch_errors_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """FET9: error rows by kind."""
    pages = _pages(spark, sf)
    return FL.errors_by_kind(FL.fetch_outcomes(D.fetch_attempts(pages), Settings().retry_count))


def q_prefetch_join(spark: SparkSession, sf: str) -> DataFrame:
    """FET10 + DSC16: prefetched pages (every page_id % 5 == 0, from the
    archive) are reused; else robots-blocked; else the fetched outcome."""
    from lexaudit.sources.readers import page_archive
    pages = _pages(spark, sf)
    s = Settings()
    fetched = FL.fetch_outcomes(D.fetch_attempts(pages), s.retry_count)
    robots = R.robots_decisions(pages.select("url"), D.robots_bodies(pages), s.user_agent)
    pre = page_archive(pages.filter(F.col("page_id") % 5 == 0))
    j = FL.crawl_join(pages.select(F.col("url").alias("target_url")), fetched, robots, pre)
    j = FL.outcome_label(j)
    return j.select("target_url", F.col("_src").alias("source"), "outcome", "status_code", "error_kind",
                    "robots_checked", "robots_allowed", "robots_decision")


# Forced compound phrases of the token queries (adjacent letter runs that
# occur in the documents).
FORCED_PHRASES = ("thethe", "theand", "orreorre", "inoran")


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    return D.tagged_tokens(_docs(spark, sf))


def q_forced_compound(spark: SparkSession, sf: str) -> DataFrame:
    """TOK6: longest forced phrase starting at each position."""
    m = forced_matches(_tagged(spark, sf), K.setting_terms(FORCED_PHRASES))
    return m.select(F.col("doc_key").cast("long").alias("doc_id"), "pos", "phrase", "n_tokens")


def q_auto_compound(spark: SparkSession, sf: str) -> DataFrame:
    """TOK4 + TOK5: keyword counts of the scan without forced phrases."""
    kw = scan_keywords(_tagged(spark, sf), compound_mode=True)
    return K.rank_frequency(K.count_normalized(kw))


def q_scan_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """TOK7: the full scan (forced phrase, else auto compound, else single)."""
    kw = scan_keywords(_tagged(spark, sf), compound_mode=True,
                       forced_phrases=K.setting_terms(FORCED_PHRASES))
    return kw.select(F.col("doc_key").cast("long").alias("doc_id"), "pos", "keyword", "kind")


def q_stopword_filter(spark: SparkSession, sf: str) -> DataFrame:
    """TOK8-TOK10 + AGG4: raw and final totals per stopword stage."""
    s = Settings(additional_stopwords_text=USER_STOPWORDS_TEXT, user_stopwords=("was", "with"))
    occ = K.noun_occurrences(_docs(spark, sf), "text", compound_mode=s.compound_mode)
    raw = K.raw_frequency(K.count_occurrences(occ), s)
    return K.keyword_totals(raw, K.final_frequency(raw, s))


def q_page_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG5: per document, keyword occurrences before and after each
    stopword stage."""
    s = Settings(additional_stopwords_text=USER_STOPWORDS_TEXT)
    occ = K.noun_occurrences(_docs(spark, sf), "text", ["doc_id"], s.compound_mode, per_text=True)
    counts = K.count_occurrences(occ, ["doc_id"])
    default = K.default_stopword_set(s)
    user = K.user_stopword_set(s)
    kw = F.col("keyword")
    return counts.groupBy("doc_id").agg(
        F.sum("freq").alias("tokens"),
        F.sum(F.when(~kw.isin(*default), F.col("freq")).otherwise(0)).alias("after_default"),
        F.sum(F.when(~kw.isin(*default) & ~kw.isin(*user), F.col("freq")).otherwise(0)).alias("after_user"))


# Page cap per site of the sitemap queries and of feed_status.
SITE_MAX_PAGES = 2


def q_sitemap_locs(spark: SparkSession, sf: str) -> DataFrame:
    """DSC7: locs of every derived sitemap document."""
    docs = D.sitemap_documents(_pages(spark, sf, ("page_id", "url")))
    p = DS.parse_sitemaps(docs)
    return p.select("sitemap_url", F.posexplode("locs").alias("loc_pos", "loc"))


def q_sitemap_status(spark: SparkSession, sf: str) -> DataFrame:
    """DSC7 + DSC8: status and loc count per derived sitemap document."""
    docs = D.sitemap_documents(_pages(spark, sf, ("page_id", "url")))
    p = DS.parse_sitemaps(docs)
    return p.select("sitemap_url", "fetch_status", F.size("locs").alias("url_count"))


def _sitemap_run(spark: SparkSession, sf: str):
    pages = _pages(spark, sf, ("page_id", "url"))
    sites = D.sites_from_pages(pages, SITE_MAX_PAGES)
    seeds = DS.sitemap_seeds(sites, D.robots_bodies(pages))
    return sites, DS.sitemap_targets(seeds, D.sitemap_documents(pages), sites, Settings().exclude_url_patterns)


def q_sitemap_traverse(spark: SparkSession, sf: str) -> DataFrame:
    """DSC6, DSC9: documents fetched per site, in queue order, until the cap."""
    _, (_, sources) = _sitemap_run(spark, sf)
    # Rank within the level for the report (a window over the fetched
    # documents of one site and level, a bounded set).
    w = Window.partitionBy("site_id", "level").orderBy("key")
    return sources.withColumn("rank", F.row_number().over(w)).drop("key")


def q_sitemap_targets(spark: SparkSession, sf: str) -> DataFrame:
    """DSC10: sitemap URLs accepted per site (first wins, capped)."""
    _, (targets, _) = _sitemap_run(spark, sf)
    return targets.drop("_pos")


def _bfs_inputs(spark: SparkSession, sf: str):
    from lexaudit.functions.urls import with_normalized_url
    pages = _pages(spark, sf, ("page_id", "url"))
    edges = D.link_graph(pages)
    src_norm = with_normalized_url(pages, "url", True, "normalized_url", "_r").select(
        F.col("url").alias("src_url"), F.col("normalized_url").alias("_src_norm"))
    edges = edges.join(src_norm, "src_url").select(F.col("_src_norm").alias("src_url"), "link_pos", "dst_url")
    # One site per origin, seeded with the origin's first page (DSC14).
    origin = F.regexp_extract(F.col("url"), "^(https?://[^/?#]+)", 1)
    first = pages.groupBy(origin.alias("site_id")).agg(F.min_by("url", "page_id").alias("url"))
    seeds = (with_normalized_url(first, "url", True, "normalized_url", "_r")
             .select("site_id", F.lit(0).cast("long").alias("seed_rank"), "normalized_url"))
    return edges, seeds, D.sites_from_pages(pages, BFS_MAX_PAGES, 8)


# Cap of the capped walk.
BFS_MAX_PAGES = 20


def q_bfs_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """DSC13 without a cap that binds: every URL of the site reachable from
    its first page within the depth limit, with its BFS depth."""
    from lexaudit.operators.frontier import bfs
    edges, seeds, sites = _bfs_inputs(spark, sf)
    s = Settings()
    everything = sites.withColumn("max_pages", F.lit(None).cast("int")).withColumn("max_depth", F.lit(s.max_depth))
    _, found = bfs(edges, seeds, s.max_depth, sites=everything, exclude_patterns=s.exclude_url_patterns)
    return found.select("site_id", "normalized_url", "depth")


def q_bfs_capped(spark: SparkSession, sf: str) -> DataFrame:
    """DSC13 with the page cap."""
    from lexaudit.operators.frontier import bfs
    edges, seeds, sites = _bfs_inputs(spark, sf)
    targets, discovered = bfs(edges, seeds, 8, sites=sites, exclude_patterns=Settings().exclude_url_patterns)
    t = targets.select("site_id", "normalized_url", F.lit(True).alias("is_target"))
    return discovered.join(t, ["site_id", "normalized_url"], "left").select(
        "site_id", "normalized_url", "depth", "discovered_from", F.coalesce("is_target", F.lit(False)).alias("is_target"))


def q_feed_status(spark: SparkSession, sf: str) -> DataFrame:
    """DSC1-DSC3, DSC5: feed candidates tried per site, with status."""
    pages = _pages(spark, sf, ("page_id", "url"))
    sites = D.sites_from_pages(pages, SITE_MAX_PAGES)
    per_page = min(100, max(1, SITE_MAX_PAGES))
    res = DS.feed_results(DS.feed_candidates(sites), D.feed_pages(pages, per_page), SITE_MAX_PAGES)
    return res.filter("fetched").select("site_id", "candidate_pos", "api_url", "discovered_from", "fetch_status",
                                        "url_count", "page_count", "chosen")


def q_feed_links(spark: SparkSession, sf: str) -> DataFrame:
    """DSC4 + DSC10 without a cap: every page of each site's feed is read and
    every URL accepted is kept (first wins)."""
    pages = _pages(spark, sf, ("page_id", "url"))
    s = Settings()
    sites = written(D.sites_from_pages(pages, s.max_pages).withColumn("max_pages", F.lit(None).cast("int")))
    feed = written(DS.feed_page_status(D.feed_pages(pages, DS.FEED_PAGE_SIZE)))
    res = DS.feed_results(DS.feed_candidates(sites), feed, None)
    return DS.feed_targets(res, sites, s.exclude_url_patterns, s.exclude_pdf, feed).drop("_pos")


def _collect(spark: SparkSession, sf: str):
    from lexaudit.operators.frontier import link_edges
    pages = _pages(spark, sf)
    s = Settings()
    sites = D.sites_from_pages(pages, s.max_pages, s.max_depth)
    e = link_edges(pages, "page_id", "url", "html")
    src = U.with_normalized_url(pages.select("page_id", "url"), "url", True, "_n", "_r").select(
        F.col("page_id").alias("src_key"), F.col("_n").alias("_src_norm"))
    edges = e.join(src, "src_key").select(F.col("_src_norm").alias("src_url"), "link_pos", "dst_url")
    return DS.collect_domain(sites, s, feed_pages=D.feed_pages(pages, min(100, s.max_pages)),
                             robots=D.robots_bodies(pages), sitemap_docs=D.sitemap_documents(pages),
                             edges=edges)


def q_domain_collect(spark: SparkSession, sf: str) -> DataFrame:
    """DSC10, DSC11, DSC13-DSC16: targets per site and their source."""
    return _collect(spark, sf)["targets"]


def q_domain_summary(spark: SparkSession, sf: str) -> DataFrame:
    """DSC17: per-site collection counters."""
    return _collect(spark, sf)["summary"]


def _pipeline(spark: SparkSession, sf: str):
    from lexaudit.plans.pipeline import run_analysis
    pages = _pages(spark, sf)
    s = Settings(max_list_urls=0, additional_stopwords_text=USER_STOPWORDS_TEXT)
    # The fetch log is keyed by the URL that is fetched: the normalised URL
    # (one log per URL: the first page of a normalised URL answers).
    fetched_pages = (U.with_normalized_url(pages, "url", True, "_n", "_r")
                     .groupBy(F.col("_n").alias("url"))
                     .agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html")))
    return run_analysis(settings=s, urls=D.url_variants(pages.select("page_id", "url")),
                        attempts=D.fetch_attempts(fetched_pages), robots_bodies=D.robots_bodies(pages))


def q_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """API1 + AGG8: the one-row summary of a full run on derived inputs."""
    return _pipeline(spark, sf).summary


def q_pipeline_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """API1: final keyword ranking of a full run (URL list -> attempt log ->
    robots -> audit -> primary/fallback text -> keywords)."""
    return _pipeline(spark, sf).keyword_frequency


def q_rerun_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """API2: re-run the keyword stage from a stored text audit with other
    stopwords (inclusion is not decided again)."""
    from lexaudit.plans.pipeline import rerun_analysis
    from lexaudit.sources.readers import page_archive
    pages = _pages(spark, sf)
    audit = A.analyze_pages(page_archive(pages).withColumn("page_key", F.col("target_url")), Settings())
    r = rerun_analysis(audit, Settings(user_stopwords=("the", "and", "der", "die", "que", "les")))
    return r.keyword_frequency


QUERIES: dict[str, QueryFn] = {
    "keyword_raw": q_keyword_raw,
    "keyword_final": q_keyword_final,
    "keyword_topn": q_keyword_topn,
    "script_tokens": q_script_tokens,
    "url_normalize": q_url_normalize,
    "url_classify": q_url_classify,
    "url_cap": q_url_cap,
    "url_registered_domain": q_url_registered_domain,
    "url_suffix_domain": q_url_suffix_domain,
    "url_scope": q_url_scope,
    "container_text": q_container_text,
    "block_text": q_block_text,
    "title_text": q_title_text,
    "noindex": q_noindex,
    "url_audit": q_url_audit,
    "page_keywords": q_page_keywords,
    "keywords_per_site": q_keywords_per_site,
    "link_edges": q_link_edges,
    "url_resolve": q_url_resolve,
    "robots_rules": q_robots_rules,
    "robots_decisions": q_robots_decisions,
    "fetch_outcome": q_fetch_outcome,
    "fetch_errors_by_kind": q_fetch_errors_by_kind,
    "prefetch_join": q_prefetch_join,
    "forced_compound": q_forced_compound,
    "auto_compound": q_auto_compound,
    "scan_tokens": q_scan_tokens,
    "stopword_filter": q_stopword_filter,
    "page_token_counts": q_page_token_counts,
    "sitemap_locs": q_sitemap_locs,
    "sitemap_status": q_sitemap_status,
    "sitemap_traverse": q_sitemap_traverse,
    "sitemap_targets": q_sitemap_targets,
    "bfs_frontier": q_bfs_frontier,
    "bfs_capped": q_bfs_capped,
    "feed_status": q_feed_status,
    "feed_links": q_feed_links,
    "domain_collect": q_domain_collect,
    "domain_summary": q_domain_summary,
    "run_summary": q_run_summary,
    "pipeline_keywords": q_pipeline_keywords,
    "rerun_keywords": q_rerun_keywords,
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked keywords of the page archive."""
    return q_page_keywords(spark, sf)
