"""End-to-end jobs (API1-API3, AGG8): lazy DataFrames wired stage by stage.

The fetch is an input contract (an attempt log, or a page archive); robots
bodies, sitemaps and feeds are tables too. Nothing here collects data to the
driver; the run summary is a one-row aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit import schemas
from lexaudit.operators.tokens import scan_keywords, script_tokens
from lexaudit.operators import audit as A
from lexaudit.operators import fetchlog as FL
from lexaudit.operators import keywords as K
from lexaudit.operators import robots as R
from lexaudit.operators.discovery import collect_domain  # noqa: F401  (API3)
from lexaudit.operators.urls import classify_urls, skipped, targets as target_rows
from lexaudit.session import cut_lineage
from lexaudit.settings import Settings


@dataclass
class AnalysisTables:
    """All outputs of one run (lazy)."""
    target_urls: DataFrame | None
    skipped_urls: DataFrame | None
    fetched_pages: DataFrame | None
    text_audit: DataFrame
    raw_frequency: DataFrame
    keyword_frequency: DataFrame
    top_keywords: DataFrame
    summary: DataFrame
    extra: dict = field(default_factory=dict)


def keyword_occurrences(pages: DataFrame, settings: Settings, group_cols=(), tagger=None) -> DataFrame:
    """Keyword occurrences (*group_cols, raw) of ``pages.extracted_text``: read
    off the text where the built-in tagger works without forced phrases, else
    by the full scan. ``tagger(df, key_col, text_col)`` gives the tokens of
    any other analyser in the ``morph_tokens`` contract."""
    phrases = K.forced_phrase_list(settings)
    if not phrases and tagger is None:
        return K.noun_occurrences(pages, "extracted_text", list(group_cols), settings.compound_mode)
    names = [f"_g{i}" for i in range(len(group_cols))]
    keyed = pages.select(F.to_json(F.struct(F.monotonically_increasing_id().alias("_row"),
                                            *[F.col(c).alias(n) for c, n in zip(group_cols, names)])).alias("doc_key"),
                         "extracted_text")
    # One numbering of the pages for every branch of the scan.
    tokens = cut_lineage((tagger or script_tokens)(cut_lineage(keyed), "doc_key", "extracted_text"))
    found = scan_keywords(tokens, compound_mode=settings.compound_mode, forced_phrases=phrases)
    return found.select(*[F.get_json_object("doc_key", f"$.{n}").alias(c) for c, n in zip(group_cols, names)],
                        F.col("keyword").alias("raw"))


def keyword_tables(text_audit: DataFrame, settings: Settings, group_cols=(),
                   tagger=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """AGG1-AGG3, AGG6, AGG7 from a ``text_audit`` table: included pages with
    text -> noun occurrences -> counts -> default / user stopwords -> ranks."""
    pages = text_audit.filter(F.col("included_in_analysis") & (F.coalesce(F.col("extracted_text"), F.lit("")) != ""))
    occ = keyword_occurrences(pages, settings, group_cols, tagger)
    counts = K.count_occurrences(occ, list(group_cols))
    raw = K.raw_frequency(counts, settings)
    final = K.final_frequency(raw, settings)
    return (K.rank_frequency(raw, list(group_cols)), K.rank_frequency(final, list(group_cols)),
            K.top_n(final, settings.top_n_wordcloud) if not group_cols else
            K.top_n_per_group(final, list(group_cols), settings.top_n_wordcloud))


def run_summary(*, audit: DataFrame, raw: DataFrame, final: DataFrame, fetched: DataFrame | None = None,
                classified: DataFrame | None = None, mode: str = "full") -> DataFrame:
    """AGG8: one row of counters. Each part is a one-row aggregate; they are
    combined by a union + single aggregate (no cross join)."""
    parts = []

    def part(df: DataFrame, **named):
        cols = [F.lit(None).cast("long").alias(k) for k in ALL_COUNTERS]
        sel = {k: v for k, v in named.items()}
        return df.agg(*[sel.get(k, F.lit(None).cast("long")).cast("long").alias(k) for k in ALL_COUNTERS]) \
            if sel else df.select(*cols)

    if classified is not None:
        parts.append(part(classified, input_urls=F.count(F.lit(1)),
                          target_urls=F.count_if(F.col("skip_reason").isNull()),
                          skipped_urls=F.count_if(F.col("skip_reason").isNotNull())))
    if fetched is not None:
        lab = FL.outcome_label(fetched)
        parts.append(part(lab, crawl_success=F.count_if(F.col("outcome") == "success"),
                          crawl_errors=F.count_if(F.col("outcome") == "error"),
                          robots_blocked=F.count_if(F.col("outcome") == "blocked"),
                          count_404=F.count_if(F.col("error_kind").isin("http_404", "not_found")),
                          count_410=F.count_if(F.col("error_kind") == "gone")))
    parts.append(part(audit, audited_pages=F.count(F.lit(1)),
                      analyzed_pages=F.count_if(F.col("included_in_analysis")
                                                & (F.coalesce(F.col("extracted_text"), F.lit("")) != "")),
                      noindex_pages=F.count_if(F.col("noindex_status") == "noindex")))
    totals = K.keyword_totals(raw, final)
    parts.append(part(totals, raw_total_tokens=F.first("raw_total_tokens"),
                      raw_unique_keywords=F.first("raw_unique_keywords"),
                      final_total_tokens=F.first("final_total_tokens"),
                      final_unique_keywords=F.first("final_unique_keywords")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    s = u.agg(*[F.max(k).alias(k) for k in ALL_COUNTERS])
    return s.withColumn("has_keywords", F.coalesce(F.col("final_unique_keywords"), F.lit(0)) > 0) \
        .withColumn("execution_mode", F.lit(mode))


ALL_COUNTERS = ("input_urls", "target_urls", "skipped_urls", "crawl_success", "crawl_errors", "robots_blocked",
                "count_404", "count_410", "audited_pages", "analyzed_pages", "noindex_pages",
                "raw_total_tokens", "raw_unique_keywords", "final_total_tokens", "final_unique_keywords")


def run_analysis(*, settings: Settings, urls: DataFrame | None = None, attempts: DataFrame | None = None,
                 archive: DataFrame | None = None, robots_bodies: DataFrame | None = None,
                 prefetched: DataFrame | None = None, tagger=None) -> AnalysisTables:
    """API1: URL list -> classify -> crawl join (attempt log or archive,
    robots) -> audit and extraction -> keywords -> summary.

    ``urls``: ``(site_id?, input_pos, original_url)``; ``attempts``: the
    fetch-attempt log; ``archive``: ``fetched_pages`` rows (used when no log
    is given); ``robots_bodies``: robots table (respected when the setting
    says so)."""
    s = settings
    classified = None
    fetched = archive
    if urls is not None:
        # Each stage output is checkpointed to the shared checkpoint folder:
        # short lineage for the next stage, and a restart point if
        # executors are lost.
        classified = cut_lineage(classify_urls(urls, exclude_patterns=s.exclude_url_patterns,
                                               max_urls=s.list_cap, exclude_pdf=s.exclude_pdf))
        t = target_rows(classified).select(F.col("normalized_url").alias("target_url"))
        if attempts is not None:
            got = FL.fetch_outcomes(attempts, s.retry_count)
        else:
            got = archive
        robots = None
        if s.respect_robots_txt and robots_bodies is not None:
            robots = R.robots_decisions(t.select(F.col("target_url").alias("url")), robots_bodies, s.user_agent)
        fetched = cut_lineage(FL.crawl_join(t, got, robots, prefetched))
    if fetched is None:
        raise ValueError("give urls with attempts/archive, or an archive")
    cols = [f.name for f in schemas.FETCHED_PAGES.fields]
    pages = fetched.select(*cols).withColumn("page_key", F.col("target_url"))
    audit = cut_lineage(A.analyze_pages(pages, s))
    raw, final, top = keyword_tables(audit, s, tagger=tagger)
    summary = run_summary(audit=audit, raw=raw, final=final, fetched=fetched, classified=classified)
    return AnalysisTables(
        target_urls=target_rows(classified) if classified is not None else None,
        skipped_urls=skipped(classified) if classified is not None else None,
        fetched_pages=fetched, text_audit=audit, raw_frequency=raw, keyword_frequency=final,
        top_keywords=top, summary=summary)


def rerun_analysis(text_audit: DataFrame, settings: Settings, tagger=None) -> AnalysisTables:
    """API2: re-run from cached text. Only stopword, compound and top-N
    settings take effect; inclusion is not decided again."""
    raw, final, top = keyword_tables(text_audit, settings, tagger=tagger)
    summary = run_summary(audit=text_audit, raw=raw, final=final, mode="cached_text")
    return AnalysisTables(target_urls=None, skipped_urls=None, fetched_pages=None, text_audit=text_audit,
                          raw_frequency=raw, keyword_frequency=final, top_keywords=top, summary=summary)
