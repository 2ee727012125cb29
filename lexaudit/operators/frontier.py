"""Link graph (DSC12) and the level-synchronous BFS over it (DSC13-DSC15)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.session import written

from lexaudit.functions.urls import first_matching_pattern, in_scope, url_host, with_normalized_url, with_resolved_url
from lexaudit.operators import html as H


def link_edges(pages: DataFrame, key_col: str, url_col: str, html_col: str,
               exclude_pdf: bool = True) -> DataFrame:
    """DSC12: ``a[href]`` in page order, stripped, resolved against the
    page's final URL, normalised (URL1); links with a skip reason are
    dropped; first occurrence per normalised URL within a page.
    Returns ``(src_key, src_url, link_pos, absolute_url, dst_url)``; the edge
    table of all pages is built in one pass."""
    toks = H.html_tokens(pages.select(F.col(key_col).alias("_k"), F.col(html_col).alias("_h")), "_k", "_h")
    hrefs = H.anchor_hrefs(toks).filter(F.col("href") != "")
    base = pages.select(F.col(key_col).alias("page_key"), F.col(url_col).alias("src_url"))
    e = hrefs.join(base, "page_key")
    e = with_resolved_url(e, "src_url", "href", "absolute_url")
    e = with_normalized_url(e, "absolute_url", exclude_pdf, "dst_url", "_reason")
    # Rejected links are dropped inside the aggregate (ordering key NULL)
    # rather than by a filter on the derived reason: Catalyst would push such
    # a filter below the projections and inline the whole URL algebra into it.
    ok_pos = F.when(F.col("_reason").isNull(), F.col("link_pos"))
    firsts = e.groupBy("page_key", "src_url", "dst_url").agg(
        F.min_by(F.struct("link_pos", "absolute_url"), ok_pos).alias("_f"),
        F.min(ok_pos).alias("_first"))
    firsts = firsts.filter(F.col("_first").isNotNull())
    return firsts.select(F.col("page_key").alias("src_key"), "src_url",
                         F.col("_f.link_pos").alias("link_pos"), F.col("_f.absolute_url").alias("absolute_url"),
                         "dst_url")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None, max_pages: int | None = None,
        allowed: DataFrame | None = None, sites: DataFrame | None = None,
        exclude_patterns=()) -> tuple[DataFrame, DataFrame]:
    """DSC13-DSC15: level-synchronous BFS over the link graph.

    ``edges``: ``(src_url, link_pos, dst_url)`` keyed by the normalised URL
    of the source page. ``seeds``: ``(site_id, seed_rank, normalized_url)``
    (DSC14 order: start URL first). ``allowed``: optional ``(normalized_url,
    allowed)`` robots decisions (missing = allowed). ``sites``: ``(site_id,
    start_url, include_subdomains, max_pages, max_depth)``; with it a link
    must be in its site's scope (URL13), and each site has its own cap and
    depth, ``max_pages`` / ``max_depth`` being the values of other sites.
    ``exclude_patterns``: links that hold one are not followed (URL6).

    A level is one join of the frontier with the edges, anti joins with the
    levels before it and a per-site first-occurrence pick by ``(parent rank,
    link position)`` -- the FIFO order of a queue walk. Pages at the depth
    limit are not expanded. The edges are written once in buckets of their
    source, so no level moves them; links found are dealt once by site and
    URL, which serves all anti joins and the pick. Each level is written.

    Without a cap returns ``(discovered, discovered)``; with one the
    cap rule of the queue walk is applied: blocked seeds count -1, allowed
    new links +1, blocked new links 0; S is the first event where the
    running total reaches the cap; targets are the allowed links up to S
    and discovered keeps, on S's page, the links up to the next allowed
    one after S. The cap is decided per level: a site that reached it is not
    walked further. Returns ``(targets, discovered)``.
    """
    allow = allowed.select("normalized_url", F.col("allowed").alias("_allowed")) if allowed is not None else None
    # The edge table is read once per level: materialise it once.
    e = edges.select(F.col("src_url").alias("_src"), "link_pos", "dst_url")
    e = e.filter(first_matching_pattern(F.col("dst_url"), exclude_patterns).isNull())
    e = written(e.withColumn("_host", url_host(F.col("dst_url"))), by="_src")
    site_ids = seeds.select("site_id").distinct()
    if sites is not None:
        site_ids = site_ids.join(sites.select("site_id", url_host(F.col("start_url")).alias("_root"),
                                              F.col("include_subdomains").alias("_sub"),
                                              F.col("max_pages").alias("_cap"), F.col("max_depth").alias("_deep")),
                                 "site_id", "left")
    else:
        site_ids = site_ids.withColumns({"_root": F.lit(None).cast("string"), "_sub": F.lit(None).cast("boolean"),
                                         "_cap": F.lit(None).cast("int"), "_deep": F.lit(None).cast("int")})
    site_ids = site_ids.withColumn("_cap", F.coalesce("_cap", F.lit(max_pages).cast("int")))
    site_ids = written(site_ids.withColumn("_deep", F.coalesce("_deep", F.lit(max_depth).cast("int"))))
    capped = not site_ids.filter(F.col("_cap").isNotNull()).isEmpty()
    # What a site may still add: its cap less its seeds, one back per blocked seed.
    room = None
    # Queue order is a path key: the parent's key plus the link position
    # (arrays compare lexicographically), so no per-site window is needed
    # to rank a level -- a site with millions of URLs in one level is not
    # sent to one task.
    front = seeds.select("site_id", F.lit(0).alias("depth"), F.array(F.col("seed_rank").cast("long")).alias("key"),
                         "normalized_url", F.lit(None).cast("string").alias("discovered_from"))
    if allow is not None:
        front = front.join(allow, "normalized_url", "left")
    else:
        front = front.withColumn("_allowed", F.lit(True))
    front = written(front.withColumn("_allowed", F.coalesce(F.col("_allowed"), F.lit(True))))
    levels = [front]
    walked = site_ids
    if capped:
        room = written(front.groupBy("site_id").agg(
            F.count_if(F.col("_allowed")).alias("_n"), F.count(F.lit(1)).alias("_n_seeds"))
            .join(site_ids, "site_id"))
    depth = 0
    while True:
        depth += 1
        if capped:
            # A total that ever reached the cap has an event S by now.
            walked = room.filter((F.col("_n_seeds") < F.col("_cap")) & (F.col("_n") < F.col("_cap"))) \
                .select(*site_ids.columns)
        walked = walked.filter(F.col("_deep").isNull() | (F.col("_deep") >= depth))
        expand = front.filter(F.col("_allowed")).join(walked, "site_id")
        kids = expand.select("site_id", F.col("key").alias("_pkey"), F.col("normalized_url").alias("_src"), "_root", "_sub") \
            .join(e, "_src")
        inside = F.col("_root").isNull() | ((F.col("_host") != "") & F.coalesce(
            in_scope(F.col("_host"), F.col("_root"), F.col("_sub")), F.lit(False)))
        kids = kids.filter(inside).select("site_id", "_pkey", F.col("link_pos").cast("long").alias("link_pos"),
                                          F.col("dst_url").alias("normalized_url"), F.col("_src").alias("discovered_from"))
        for done in levels:
            kids = kids.join(done.select("site_id", "normalized_url"), ["site_id", "normalized_url"], "left_anti")
        first = kids.groupBy("site_id", "normalized_url").agg(
            F.min_by(F.struct("_pkey", "link_pos", "discovered_from"), F.struct("_pkey", "link_pos")).alias("_k"))
        nxt = first.select("site_id", F.lit(depth).alias("depth"),
                           F.concat(F.col("_k._pkey"), F.array(F.col("_k.link_pos"))).alias("key"),
                           "normalized_url", F.col("_k.discovered_from").alias("discovered_from"))
        if allow is not None:
            nxt = nxt.join(allow, "normalized_url", "left")
        else:
            nxt = nxt.withColumn("_allowed", F.lit(True))
        nxt = written(nxt.withColumn("_allowed", F.coalesce(F.col("_allowed"), F.lit(True))))
        if nxt.isEmpty():
            break
        levels.append(nxt)
        front = nxt
        if capped:
            more = nxt.groupBy("site_id").agg(F.count_if(F.col("_allowed")).alias("_more"))
            room = written(room.join(more, "site_id", "left").withColumn(
                "_n", F.col("_n") + F.coalesce("_more", F.lit(0))).drop("_more"))
    out = functools.reduce(DataFrame.unionByName, levels).select("site_id", "normalized_url", "depth", "key", "discovered_from", "_allowed")
    if not capped:
        return out, out
    # Cap rule over events in queue order (depth, key): a blocked seed
    # counts -1, an allowed new link +1, a blocked new link 0.
    ev = out.withColumn("_event", F.when(F.col("depth") == 0, F.when(F.col("_allowed"), 0).otherwise(-1))
                        .otherwise(F.when(F.col("_allowed"), 1).otherwise(0)))
    ws = Window.partitionBy("site_id").orderBy("depth", "key").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.join(room.select("site_id", "_n_seeds", "_cap"), "site_id").withColumn("_total", F.col("_n_seeds") + F.sum("_event").over(ws))
    pos = F.struct("depth", "key")
    s_pos = ev.filter(F.col("_total") >= F.col("_cap")).groupBy("site_id").agg(F.min(pos).alias("_s"))
    ev = ev.join(s_pos, "site_id", "left")
    upto_s = F.col("_s").isNull() | (pos <= F.col("_s"))
    targets = ev.filter((F.col("depth") > 0) & F.col("_allowed") & upto_s)
    # On S's page: links after S up to and including the next allowed one.
    parent = F.slice("key", 1, F.size("key") - 1)
    s_parent = F.slice(F.col("_s.key"), 1, F.size(F.col("_s.key")) - 1)
    same_page = (F.col("depth") == F.col("_s.depth")) & (parent == s_parent) & (pos > F.col("_s"))
    nxt_allowed = ev.filter(same_page & F.col("_allowed")).groupBy("site_id").agg(F.min("key").alias("_stop"))
    ev = ev.join(nxt_allowed, "site_id", "left")
    extra = same_page & (F.col("_stop").isNull() | (F.col("key") <= F.col("_stop")))
    discovered = ev.filter(upto_s | extra)
    cols = ["site_id", "normalized_url", "depth", "key", "discovered_from", "_allowed"]
    return targets.select(*cols), discovered.select(*cols)
