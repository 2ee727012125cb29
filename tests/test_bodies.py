"""Stored bodies: inflating, charsets, the manifest; redirects of sitemaps."""

import gzip

import pytest

from lexaudit.operators.discovery import parse_sitemaps, sitemap_seeds, traverse_sitemaps
from lexaudit.operators.redirects import final_urls, follow_redirects
from lexaudit.operators.robots import robots_decisions
from lexaudit.sources.bodies import body_text, inflate, robots_table, sitemap_table, stored_bodies

XML = '<?xml version="1.0" encoding="{}"?><urlset><url><loc>http://a.example.com/{}</loc></url></urlset>'
ROBOTS = "User-agent: *\nDisallow: /名/\nDisallow: /closed/\n"


def test_inflate_takes_all_members_and_nothing_past_the_bound():
    assert inflate(gzip.compress(b"ab") + gzip.compress(b"cd") + b"\0\0") == b"abcd"
    assert inflate(gzip.compress(b"x" * 100), 100) == b"x" * 100
    for raw, most, error in ((gzip.compress(b"x" * 10**6), 10**6 - 1, "body_too_large"), (gzip.compress(b"abc")[:-9], 99, "bad_gzip"),
                             (b"\x1f\x8bnot", 99, "bad_gzip"), (gzip.compress(b"a") + b"junk", 99, "bad_gzip")):
        with pytest.raises(ValueError, match=error):
            inflate(raw, most)


def test_charsets():
    text = "名前 é"
    for raw, kind, expected in (
            (text.encode("shift_jis", "ignore"), "text/xml; charset=Shift_JIS", "名前 "),
            (text.encode(), 'application/xml; charset="UTF-8"', text), (text.encode(), "application/xml", text),
            ("é".encode("latin-1"), "text/plain", "é"), (b"\xff\xfe" + "é".encode("utf-16-le"), "application/xml", "é"),
            ("﻿é".encode(), "application/xml; charset=utf-8", "é"), (b"a\xffb", "application/xml", "a�b"),
            (text.encode(), "application/xml; charset=no-such", text), (None, None, ""), (b"", "text/plain", ""),
            (XML.format("Shift_JIS", "名").encode("shift_jis"), None, XML.format("Shift_JIS", "名"))):
        assert body_text(raw, "http://a.example.com/x", kind) == (expected, None), kind
    assert body_text(b"plain", "http://a.example.com/x.GZ", None) == (None, "bad_gzip")
    assert body_text(b"plain", "http://a.example.com/x", "application/x-gzip") == (None, "bad_gzip")
    assert body_text(b"x" * 11, None, None, 10) == (None, "body_too_large")


def test_stored_bodies_become_robots_and_sitemap_tables(spark, tmp_path):
    files = {"1": gzip.compress(XML.format("utf-8", "gz").encode()),
             "2": XML.format("Shift_JIS", "名").encode("shift_jis"), "3": ROBOTS.encode("shift_jis"),
             "4": b"no gzip", "unused": b"x"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    o = "http://a.example.com"
    manifest = spark.createDataFrame([
        ("1", f"{o}/plain-name", 200, "application/octet-stream"), ("2", f"{o}/jp.xml", 200, "application/xml; charset=shift_jis"),
        ("3", f"{o}/robots.txt", 200, "text/plain; charset=shift_jis"), ("4", f"{o}/broken.xml.gz", 200, None),
        ("missing", f"{o}/none.xml", 404, None), (None, f"{o}/failed.xml", None, None)],
        "file string, url string, status_code long, content_type string")
    stored = stored_bodies(spark, str(tmp_path), manifest)
    assert stored.count() == 6 and {r.origin for r in stored.collect()} == {o}
    assert {r.url for r in stored.filter("body_error = 'bad_gzip'").collect()} == {f"{o}/broken.xml.gz"}
    maps = {r.sitemap_url: (r.fetch_status, r.locs) for r in parse_sitemaps(sitemap_table(stored)).collect()}
    assert maps == {f"{o}/plain-name": ("ok_urlset", [f"{o}/gz"]), f"{o}/jp.xml": ("ok_urlset", [f"{o}/名"]),
                    f"{o}/broken.xml.gz": ("parse_error", []), f"{o}/none.xml": ("http_404", []),
                    f"{o}/failed.xml": ("request_error", [])}
    urls = spark.createDataFrame([(f"{o}/名/1",), (f"{o}/closed/1",), (f"{o}/open",)], "url string")
    got = {r.url: r.allowed for r in robots_decisions(urls, robots_table(stored), "x").collect()}
    assert got == {f"{o}/名/1": False, f"{o}/closed/1": False, f"{o}/open": True}


def test_final_urls_of_chains_loops_and_trees(spark):
    chain = [(f"c{k}", f"c{k + 1}") for k in range(40)]
    rows = chain + [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("in", "l1"), ("self", "self"), ("t1", "c39"), ("t1", "zz"),
                    (None, "x"), ("n", None)]
    got = {r.url: r.final_url for r in final_urls(spark.createDataFrame(rows, "url string, target string")).collect()}
    expected = {f"c{k}": "c40" if 40 - k <= 30 else None for k in range(40)}
    expected |= {"l1": None, "l2": None, "l3": None, "in": None, "self": None, "t1": "c40"}
    assert got == expected
    assert final_urls(spark.createDataFrame([], "url string, target string")).count() == 0


def test_sitemaps_behind_redirects(spark):
    o, n = "http://a.example.com", "http://n.example.com"
    index = "<sitemapindex><sitemap><loc>pages.xml</loc></sitemap></sitemapindex>"
    docs = spark.createDataFrame([
        (f"{o}/sitemap.xml", 301, "/moved", None), (f"{o}/moved", 302, f"{n}/maps/index.xml", None),
        (f"{n}/maps/index.xml", 200, None, index), (f"{n}/maps/pages.xml", 200, None, XML.format("utf-8", "p")),
        (f"{o}/sitemap_index.xml", 301, "/sitemap_index.xml", None), (f"{o}/gone", 301, "/nowhere", None)],
        "sitemap_url string, status_code int, location string, body string")
    followed = follow_redirects(docs)
    got = {r.sitemap_url: (r.final_url, r.status_code) for r in followed.collect()}
    assert got[f"{o}/sitemap.xml"] == got[f"{o}/moved"] == (f"{n}/maps/index.xml", 200)
    assert got[f"{o}/sitemap_index.xml"] == (f"{o}/sitemap_index.xml", None) and got[f"{o}/gone"] == (f"{o}/gone", None)
    sites = spark.createDataFrame([("s", f"{o}/start")], "site_id string, start_url string")
    rows = {r.sitemap_url: r for r in traverse_sitemaps(sitemap_seeds(sites, None), followed).collect()}
    assert rows[f"{o}/sitemap.xml"].fetch_status == "ok_sitemapindex" and rows[f"{o}/sitemap_index.xml"].fetch_status == "request_error"
    # A relative loc starts from the URL after redirects.
    assert rows[f"{n}/maps/pages.xml"].locs == ["http://a.example.com/p"]
    assert rows[f"{n}/maps/pages.xml"].discovered_from == f"{n}/maps/index.xml"
