"""HTML of pages: the token table (EXT0), links (DSC12 input), and what one
pass over a page gives (``functions/pages.py``): container fallback text
(EXT5), block-scored primary text (EXT6), title (EXT3) and meta robots (EXT2
input).

``with_parts`` adds the parts of a page as a column, so a page is read once
and nothing is exchanged; each later stage is a column expression over them.
The token table is for what needs no nesting: it is split by one
``regexp_extract_all`` and only filtered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.functions.pages import (BLOCK_TAGS, EXCLUDED_TAGS, FALLBACK_SELECTORS,  # noqa: F401
                                      TOKEN_RE, VOID_TAGS, attr_pattern, fold_page, page_parts)
from lexaudit.functions.text import clean_after_unescape, unescape_udf
from lexaudit.functions.urls import py_strip


def attr_value(raw: Column, name: str) -> Column:
    """Value of attribute ``name`` in a raw start tag ('' if absent)."""
    pat = attr_pattern(name)
    return F.concat(F.regexp_extract(raw, pat, 1), F.regexp_extract(raw, pat, 2),
                    F.regexp_extract(raw, pat, 3))


def html_tokens(pages: DataFrame, key_col: str = "page_key", html_col: str = "html") -> DataFrame:
    """EXT0: ``(page_key, pos, kind, tag, raw)``; kind is one of open,
    close, text, comment, raw (a whole script/style/title element),
    other. ``raw`` keeps the token text."""
    toks = pages.select(F.col(key_col).alias("page_key"),
                        F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")),
                                                          F.lit(TOKEN_RE), 1)).alias("pos", "raw"))
    raw = F.col("raw")
    kind = (F.when(raw.startswith("<!--"), F.lit("comment"))
            .when(raw.rlike("(?is)^<(script|style|title)\\b.*</"), F.lit("raw"))
            .when(raw.startswith("</"), F.lit("close"))
            .when(raw.rlike("^<[A-Za-z]"), F.lit("open"))
            .when(raw.startswith("<!") | raw.startswith("<?"), F.lit("other"))
            .otherwise(F.lit("text")))
    tag = F.lower(F.regexp_extract(raw, "^</?([A-Za-z][^\\s/>]*)", 1))
    return toks.select("page_key", F.col("pos").cast("int").alias("pos"),
                       kind.alias("kind"), tag.alias("tag"), "raw")


def with_parts(pages: DataFrame, html: Column | str = "html", out_col: str = "parts",
               parse: Callable[[str], dict] = fold_page) -> DataFrame:
    """``pages`` with the parts of each page (a struct; a null page is an
    empty one). ``parse`` may be another function from a page to its parts."""
    html = F.col(html) if isinstance(html, str) else html
    return pages.withColumn(out_col, page_parts(F.coalesce(html, F.lit("")), parse))


def _joined(nodes: Column) -> Column:
    return clean_after_unescape(F.array_join(nodes, "\n"))


def fallback_text(parts: Column | str = "parts", selectors: Sequence[str] = FALLBACK_SELECTORS) -> Column:
    """EXT5: first selector with any non-empty cleaned text; among its
    outermost elements the longest text, first on ties; else the body text.
    Null where all are empty. A selector is only looked at where those before
    it gave nothing."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    nodes = parts["nodes"]

    def longest(k: int) -> Column:
        texts = F.transform(F.filter(parts["ranges"], lambda r: r["sel"] == k),
                            lambda r: _joined(F.slice(nodes, r["first"] + 1, r["n"])))
        ranked = F.transform(F.filter(texts, lambda t: t != ""),
                             lambda t, i: F.struct((-F.length(t)).alias("size"), i.alias("i"), t.alias("text")))
        return F.array_min(ranked)["text"]

    return F.coalesce(*[longest(k) for k in range(len(selectors))], F.nullif(_joined(nodes), F.lit("")))


def primary_text(parts: Column | str = "parts") -> Column:
    """EXT6 (re-aimed): the cleaned blocks of text that have enough characters
    and at most the given share of link text; null if there is no such block."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    return clean_after_unescape(parts["primary"])


def title_text(parts: Column | str = "parts") -> Column:
    """EXT3: text of the first ``<title>``, cleaned; null without one."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    return clean_after_unescape(parts["title"])


def meta_source(parts: Column | str = "parts") -> Column:
    """EXT2 input: which meta asks for noindex; null if none does."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    return F.concat(F.lit("meta_"), parts["meta_name"])


def page_texts(pages: DataFrame, key_col: str = "page_key", html_col: str = "html",
               keep: Sequence[str] = ()) -> DataFrame:
    """``(page_key, fallback_text, <keep>)`` of the pages that have a text."""
    p = with_parts(pages.select(F.col(key_col).alias("page_key"), html_col, *keep), html_col, "_parts")
    # Exploded, so that the filter does not clean every text a second time.
    return p.select("page_key", F.explode(F.array(fallback_text("_parts"))).alias("fallback_text"),
                    *keep).filter(F.col("fallback_text").isNotNull())


def anchor_hrefs(tokens: DataFrame) -> DataFrame:
    """DSC12 input: ``<a href>`` in page order -> ``(page_key, link_pos, href)``;
    href is entity-decoded and stripped; anchors without href are skipped."""
    a = tokens.filter((F.col("kind") == "open") & (F.col("tag") == "a"))
    a = a.select("page_key", "pos", py_strip(unescape_udf(attr_value(F.col("raw"), "href"))).alias("href"),
                 F.col("raw").rlike("(?is)[\\s\"'/]href\\s*=").alias("_has"))
    a = a.filter(F.col("_has"))
    return a.select("page_key", F.col("pos").alias("link_pos"), "href")
