"""Walk and sitemap rules on small hand-written graphs."""

from lexaudit.operators import discovery as DS
from lexaudit.operators.frontier import bfs

SITE = "site_id string, start_url string, include_subdomains boolean, max_pages int, max_depth int"


def edges(spark, links):
    rows = [(src, k, dst) for src, dsts in links.items() for k, dst in enumerate(dsts)]
    return spark.createDataFrame(rows, "src_url string, link_pos int, dst_url string")


def walk(spark, links, sites, allowed=None, **options):
    table = spark.createDataFrame(sites, SITE)
    seeds = spark.createDataFrame([(s[0], 0, s[1]) for s in sites], "site_id string, seed_rank long, normalized_url string")
    if allowed is not None:
        allowed = spark.createDataFrame(allowed, "normalized_url string, allowed boolean")
    targets, found = bfs(edges(spark, links), seeds, 3, sites=table, allowed=allowed, **options)
    return sorted((r.site_id, r.normalized_url) for r in targets.collect()), sorted((r.site_id, r.normalized_url) for r in found.collect())


def test_links_off_site_and_excluded_are_not_followed(spark):
    links = {"http://a.com/": ["http://evil.org/x", "http://a.com/tag/z", "http://a.com/1"], "http://evil.org/x": ["http://a.com/2"]}
    targets, _ = walk(spark, links, [("a", "http://a.com/", False, 10, 3)], exclude_patterns=("/tag/",))
    assert targets == [("a", "http://a.com/1")]


def test_each_site_has_its_own_cap_and_depth(spark):
    chain = {f"http://{h}.com/{k or ''}": [f"http://{h}.com/{k + 1}"] for h in "abc" for k in range(9)}
    targets, _ = walk(spark, chain, [("a", "http://a.com/", False, 3, 9), ("b", "http://b.com/", False, 50, 2), ("c", "http://c.com/", False, 6, 9)])
    assert {s: sum(t[0] == s for t in targets) for s in "abc"} == {"a": 2, "b": 2, "c": 5}


def test_a_blocked_seed_and_blocked_links(spark):
    links = {"http://a.com/": ["http://a.com/1", "http://a.com/2"]}
    site = [("a", "http://a.com/", False, 10, 3)]
    assert walk(spark, links, site, [("http://a.com/", False)])[0] == []
    targets, found = walk(spark, links, site, [("http://a.com/1", False)])
    assert targets == [("a", "http://a.com/2")] and ("a", "http://a.com/1") in found


def test_sitemap_indexes_of_any_depth_and_cycles(spark):
    deep = 20
    docs = [(f"http://a.com/s{k}.xml", 200,
             f"<sitemapindex><sitemap><loc>http://a.com/s{k + 1}.xml</loc></sitemap><sitemap><loc>http://a.com/s0.xml</loc></sitemap></sitemapindex>")
            for k in range(deep)]
    docs.append((f"http://a.com/s{deep}.xml", 200, "<urlset><url><loc>http://a.com/page</loc></url></urlset>"))
    table = spark.createDataFrame(docs, "sitemap_url string, status_code int, body string")
    seeds = spark.createDataFrame([("a", 0, "http://a.com/s0.xml", "robots")], "site_id string, seed_pos int, sitemap_url string, discovered_from string")
    done = DS.traverse_sitemaps(seeds, table).collect()
    assert len(done) == deep + 1 and sum(r.fetch_status == "ok_urlset" for r in done) == 1


def test_a_feed_may_end_with_a_page_number_error_of_status_200(spark):
    pages = spark.createDataFrame([
        ("u", 1, 1, 200, [("X-WP-Total", "2")], '[{"link": "http://a.com/1"}]'),
        ("u", 2, 1, 200, None, '{"code": "rest_post_invalid_page_number"}')],
        "api_url string, page int, per_page int, status_code int, headers array<struct<key:string,value:string>>, body string")
    status = {r.page: r.page_status for r in DS.feed_page_status(pages).collect()}
    assert status == {1: "ok", 2: "stop_invalid_page"}


def test_domain_queries_have_the_default_caps(spark, tmp_path, monkeypatch):
    from lexaudit.plans.queries import QUERIES
    from lexaudit.settings import Settings
    spark.createDataFrame([(1, "http://a.com/p", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    given = []
    monkeypatch.setattr(DS, "collect_domain", lambda sites, settings, **inputs: given.append((sites.first(), settings)) or
                        {"targets": sites, "summary": sites})
    for name in ("domain_collect", "domain_summary"):
        QUERIES[name](spark, str(tmp_path))
    assert [(r.max_pages, r.max_depth, s) for r, s in given] == [(200, 3, Settings())] * 2


def test_a_walk_under_the_default_caps_equals_a_queue_walk(spark):
    from collections import deque
    links = {f"http://a.com/{k or ''}": [f"http://a.com/{2 * k + 1}", f"http://a.com/{2 * k + 2}"] for k in range(12)}
    depth, queue = {"http://a.com/": 0}, deque(["http://a.com/"])
    while queue:
        u = queue.popleft()
        for x in links.get(u, []) if depth[u] < 3 else []:
            if x not in depth:
                depth[x] = depth[u] + 1
                queue.append(x)
    targets, _ = walk(spark, links, [("a", "http://a.com/", False, 200, 3)])
    assert targets == sorted(("a", u) for u in depth if u != "http://a.com/") and len(targets) == 14


def test_a_feed_page_carries_its_own_links_only(spark):
    from lexaudit.sources import derived as D
    pages = spark.createDataFrame([(i, f"http://a.com/{i:03d}") for i in range(200)] + [(9, "http://b.com/"), (None, "http://b.com/x")],
                                  "page_id long, url string")
    feed = D.feed_pages(pages, 2)
    rest = {(r.api_url.split("/")[2], r.page): r for r in feed.collect() if "rest_route" in r.api_url}
    assert len(rest) == 101 + 2
    assert rest["a.com", 100].body == '[{"id":198,"link":"http://a.com/198"},{"id":199,"link":"http://a.com/199"},7]'
    assert rest["a.com", 101].status_code == 400 and rest["a.com", 7].headers[0].value == "200"
    assert rest["b.com", 1].body == '[{"id":9,"link":"http://b.com/"},7]'
    plan = feed._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "slice(" not in plan


def test_feed_links_reads_every_page_of_a_feed(spark, tmp_path):
    from lexaudit.plans.queries import QUERIES
    rows = [(i, f"http://a.com/{i:03d}", "") for i in range(350)] + [(i, f"http://b.com/{i}", "") for i in range(400, 403)]
    rows += [(900, "http://a.com/007#again", ""), (901, "http://a.com/tag/x", ""), (902, "http://a.com/f.pdf", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    links = QUERIES["feed_links"](spark, str(tmp_path)).collect()
    assert sorted((r.site_id, r.original_url) for r in links) == sorted(
        (url[:12], url) for page_id, url, _ in rows if page_id < 900)
    assert {r.discovered_from for r in links if r.site_id == "http://b.com"} == {"http://b.com/index.php?rest_route=/wp/v2/posts"}


def feed_page(api_url, page, links, per_page=2, status=200):
    body = '{"code": "broken"}' if links is None else "[" + ",".join(f'{{"link": "{x}"}}' for x in links) + "]"
    return api_url, page, per_page, status, [("X-WP-Total", "9")], body


def test_results_without_a_cap_equal_those_of_a_cap_that_does_not_bind(spark):
    sites = spark.createDataFrame([(f"http://{h}.com", f"http://{h}.com/", False, 1000, 3) for h in "abcdef"], SITE)
    first, second = "http://{}.com/wp-json/wp/v2/posts", "http://{}.com/index.php?rest_route=/wp/v2/posts"
    a, b, b2, c, d, e2 = first.format("a"), first.format("b"), second.format("b"), first.format("c"), first.format("d"), second.format("e")
    rows = [feed_page(a, 1, ["/1", "/2"]), feed_page(a, 2, ["/2#x", "http://other.com/"]), feed_page(a, 3, ["/3"]), feed_page(a, 4, ["/4", "/5"]),
            # An error page fails the candidate, the next one is read.
            feed_page(b, 1, ["/1", "/2"]), feed_page(b, 2, None, status=500), feed_page(b, 3, ["/9"]),
            feed_page(b2, 1, ["/8", "/7"]), feed_page(b2, 2, []), feed_page(b2, 3, ["/6"]),
            # No terminal page is stored; a failed request; no links; no feed at all (f).
            feed_page(c, 1, ["/1", "/2"]), feed_page(c, 2, ["/3", "/4"]),
            feed_page(d, 1, ["/1", "/2"]), feed_page(d, 2, None, status=None), feed_page(e2, 1, [])]
    pages = spark.createDataFrame(rows, "api_url string, page int, per_page int, status_code int, "
                                        "headers array<struct<key:string,value:string>>, body string")
    status = DS.feed_page_status(pages)
    whole = DS.feed_results(DS.feed_candidates(sites), status, None)
    capped = DS.feed_results(DS.feed_candidates(sites), pages, 1000)
    cols = ["site_id", "candidate_pos", "api_url", "discovered_from", "fetch_status", "url_count", "page_count", "fetched", "chosen"]
    assert sorted(whole.select(cols).collect()) == sorted(capped.select(cols).collect())
    assert "post_urls" not in whole.columns
    links = [DS.feed_targets(whole, sites, ("/tag/",), True, status), DS.feed_targets(capped, sites, ("/tag/",))]
    got, expected = (sorted(tuple(r) for r in t.drop("_pos").collect()) for t in links)
    assert got == expected
    assert [(r[0][7], r[1]) for r in got] == [
        ("a", "http://a.com/1"), ("a", "http://a.com/2"), ("a", "http://a.com/3"), ("b", "http://b.com/7"), ("b", "http://b.com/8"),
        ("c", "http://c.com/1"), ("c", "http://c.com/2"), ("c", "http://c.com/3"), ("c", "http://c.com/4")]
