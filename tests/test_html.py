"""HTML token table and the container / noindex rules on small fixtures."""

from pyspark.sql import functions as F

from lexaudit.functions.text import clean_text
from lexaudit.operators import html as H
from lexaudit.operators.audit import analyze_pages, extracted_texts_table
from lexaudit.settings import Settings
from lexaudit import schemas

HTML_CASES = {
    "nested_div": "<html><body><div>a<div>inner text here</div>tail</div><div>x</div></body></html>",
    "empty_article_then_main": "<body><article> </article><main><p>main text</p></main></body>",
    "two_sections": "<body><section>abc</section><section>xyz</section></body>",
    "role_main": '<body><div role="main"><p>role text</p></div><div>other much longer text here</div></body>',
    "script_with_p": "<body><article><script>var t='</p>';</script><p>kept<p>also</article></body>",
    "comment": "<body><article><!-- hidden --><p>shown</p></article></body>",
    "header_in_article": "<body><article><header>head</header><p>body text</p><nav>menu</nav></article></body>",
    "no_container": "<html><head><title>T</title></head><body><p>plain &amp;amp; body</p></body></html>",
}
EXPECTED = {
    "nested_div": "a\ninner text here\ntail",
    "empty_article_then_main": "main text",
    "two_sections": "abc",
    "role_main": "role text",
    "script_with_p": "kept\nalso",
    "comment": "shown",
    "header_in_article": "body text",
    "no_container": "plain & body",
}


def test_fallback_containers(spark):
    df = spark.createDataFrame(list(HTML_CASES.items()), "page_key string, html string")
    got = {r["page_key"]: r["fallback_text"] for r in H.page_texts(df).collect()}
    assert got == EXPECTED


def test_clean_text(spark):
    cases = {"a\r\nb\rc": "a\nb\nc", "see https://x.org/a\u65e5\u672c next": "see next", "mail me: a.b@x.co now": "mail me: now",
             "x\t\x0b\u00a0y\u3000z": "x y z", "l1\n\n\n\nl2": "l1\n\nl2",
             "\u3000\uff21\uff22\uff11 \uff76\uff80\uff76\uff85 ": "AB1 \u30ab\u30bf\u30ab\u30ca",
             "&amp;lt;b&amp;gt;": "&lt;b&gt;", "": "", "l1 \n  l2": "l1\nl2"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = [r["c"] for r in df.select(clean_text(F.col("t")).alias("c")).collect()]
    assert got == list(cases.values())


def test_noindex_and_inclusion(spark):
    base = "<html><head>{meta}</head><body><article><p>{body}</p></article></body></html>"
    long = "word " * 40
    rows = [
        ("hdr", [("X-Robots-Tag", "googlebot: noindex")], "text/html", base.format(meta="", body=long)),
        ("meta", [], "text/html", base.format(meta='<meta name="robots" content="noindex,follow">', body=long)),
        ("gbot", [], "text/html", base.format(meta='<meta name="googlebot" content="NOINDEX">', body=long)),
        ("empty_content", [], "text/html", base.format(meta='<meta name="robots" content="">', body=long)),
        ("short", [], "", base.format(meta="", body="tiny")),
        ("pdf", [("X-Robots-Tag", "noindex")], "application/pdf", "%PDF"),
    ]
    data = [(k, k, k, 200, [{"key": a, "value": b} for a, b in h], ct, html, None, None, True, True,
             "allowed_by_robots_txt", None, None, 0.0, False, None) for k, h, ct, html in rows]
    cols = ["page_key"] + [f.name for f in schemas.FETCHED_PAGES.fields]
    schema = "page_key string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.FETCHED_PAGES.fields)
    df = spark.createDataFrame(data, schema).select(*cols)
    got = {r["page_key"]: r for r in analyze_pages(df, Settings()).collect()}
    assert got["hdr"]["noindex_source"] == "x_robots_tag" and got["hdr"]["included_in_analysis"]
    assert got["meta"]["noindex_source"] == "meta_robots"
    assert got["gbot"]["noindex_source"] == "meta_googlebot"
    assert got["empty_content"]["noindex_status"] == "not_noindex"
    assert got["short"]["excluded_reason"] == "low_text"
    assert got["pdf"]["excluded_reason"] == "non_html" and got["pdf"]["noindex_status"] == "noindex"
    got2 = {r["page_key"]: r for r in analyze_pages(df, Settings(exclude_noindex_pages=True)).collect()}
    assert got2["meta"]["excluded_reason"] == "noindex_excluded"


def test_quoted_angle_brackets_and_entities_in_links(spark):
    html = '<p><a title="a > b" href="/y">t</a><a href="/x?a=1&amp;b=2">u</a><a title=it\'s href=\'/z\'>v</a> end</p>'
    df = spark.createDataFrame([("k", html)], "page_key string, html string")
    toks = H.html_tokens(df, "page_key", "html")
    assert [r["href"] for r in H.anchor_hrefs(toks).orderBy("link_pos").collect()] == ["/y", "/x?a=1&b=2", "/z"]
    assert [r["raw"] for r in toks.filter("kind = 'text'").orderBy("pos").collect()] == ["t", "u", "v", " end"]


# Elements whose end tag is left out, or whose end comes with their parent's.
UNCLOSED = {
    "option": ("<body><select><option>A<option>B</select><article>text</article></body>", "text"),
    "optgroup": ("<body><select><optgroup><option>A<optgroup><option>B</select><main>text</main></body>", "text"),
    "li": ("<body><article><ul><li>one<li>two <b>bold<li>three</ul>tail</article>out</body>",
           "one\ntwo\nbold\nthree\ntail"),
    "li_nested": ("<body><main><ul><li>a<ul><li>b<li>c</ul><li>d</ul></main><div>longer than the main text</div>",
                  "a\nb\nc\nd"),
    "p": ("<body><section><p>one<p>two<div>three</div></section><p>out", "one\ntwo\nthree"),
    "nav": ("<body><div><nav>menu</div><article>text</article></body>", "text"),
    "nav_bounds_li": ("<body><ul><li><nav>menu<li>item</ul>after</body>", "after"),
    "nav_to_end": ("<body><p>before</p><nav>menu<article>inside</article></body>", "before"),
    "cells": ("<body><article><table><tr><td>a<td>b<tr><th>c</table>d</article>e</body>", "a\nb\nc\nd"),
    "stray_close_in_cell": ("<body><article><table><tr><td>a</article>b</td></tr></table>c</article>d</body>",
                            "a\nb\nc"),
    "stray_close": ("<body></div></nav><article>a</section>b</article></body>", "a\nb"),
    "inline_over_block": ("<body><b><article>a</b>b</article>c</body>", "a\nb"),
    "role_inline": ('<body><span role=main>a<div>b</span>c</div>d</body>', "a\nb"),
    "head": ("<head><title>t</title><meta name=a><p>body text</body>", "body text"),
    "svg": ("<body><svg><path d='x'/><text>no</text></svg><svg/><p>yes</p></body>", "yes"),
    "script_to_end": ("<body><p>a</p><script>if (a<b) x = '<p>no</p>'", "a"),
    "two_longest_tie": ("<body><div>abc</div><div>xyz</div></body>", "abc"),
    "link_in_link": ("<body><main><a href=x>a<a href=y>b</a> c</main></body>", "a\nb\nc"),
    "empty": ("", None), "null": (None, None), "only_tags": ("<body><br><hr></body>", None),
    "only_url": ("<body><article>https://x.org/a</article><div>kept</div></body>", "kept"),
}


def test_elements_without_end_tags(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in UNCLOSED.items()], "page_key string, html string")
    got = {r["page_key"]: r["fallback_text"] for r in H.page_texts(df).collect()}
    assert got == {k: v[1] for k, v in UNCLOSED.items() if v[1] is not None}


def test_blocks_by_link_share(spark):
    html = ("<head><title> A &amp;amp; B </title></head><body><p>some text <a href=x>link</a></p>"
            "<p><a href=x>only links here</a></p><header>no</header><div>end&nbsp;x</div></body>")
    df = spark.createDataFrame([(1, html), (2, "<p><a>all link</a></p>"), (3, None)], "page_key long, html string")
    out = H.with_parts(df).select("page_key", H.primary_text().alias("p"), H.title_text().alias("t"))
    got = {r["page_key"]: (r["p"], r["t"]) for r in out.collect()}
    assert got == {1: ("some textlink\nend x", "A & B"), 2: (None, None), 3: (None, None)}


def test_deep_and_long_page(spark):
    deep = "<div>" * 20000 + "core" + "</div>" * 20000
    long = "<article>" + "<p>word " * 100000 + "</article>"
    df = spark.createDataFrame([("deep", deep), ("long", long)], "page_key string, html string")
    got = {r["page_key"]: r["n"] for r in H.page_texts(df).select("page_key", F.length("fallback_text").alias("n")).collect()}
    assert got == {"deep": 4, "long": 5 * 100000 - 1}


def _fetched(spark, rows):
    data = [(k, k, k, 200, [], "text/html", html, err, None, True, allowed, "allowed_by_robots_txt", None, None,
             0.0, False, None) for k, html, err, allowed in rows]
    schema = "page_key string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.FETCHED_PAGES.fields)
    return spark.createDataFrame(data, schema)


def test_a_page_that_raises_has_a_row_of_its_own(spark):
    def parse(page):
        if "boom" in page:
            raise ValueError("no such page")
        if "wrong" in page:
            return {"title": 3}
        return H.fold_page(page)

    page = '<head><title>T</title><meta name="robots" content="noindex"></head><article>' + "word " * 60 + "{}</article>"
    df = _fetched(spark, [("ok", page.format(""), None, True), ("bad", page.format("boom"), None, True),
                          ("type", page.format("wrong"), None, True),
                          ("blocked", page.format("boom"), None, False), ("late", page.format("boom"), "timeout", True)])
    got = {r["page_key"]: r for r in analyze_pages(df.coalesce(1), Settings(), parse=parse).collect()}
    assert {k: r["excluded_reason"] for k, r in got.items()} == {
        "ok": "", "bad": "extract_exception:ValueError", "type": "extract_exception:ArrowTypeError",
        "blocked": "robots_blocked", "late": "timeout"}
    bad = got["bad"]
    assert (bad["noindex_status"], bad["noindex_source"], bad["noindex_value"]) == ("unknown", "", "")
    assert (bad["extracted_text"], bad["extracted_chars"], bad["extraction_method"]) == ("", 0, "")
    assert not bad["extraction_success"] and not bad["included_in_analysis"] and bad["robots_txt"] == "allowed"
    assert got["ok"]["noindex_status"] == "noindex" and got["ok"]["extraction_success"]


def test_audit_is_one_pass_without_exchange(spark):
    plan = analyze_pages(_fetched(spark, [("a", "<p>x</p>", None, True)]), Settings())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_texts_are_kept_only_where_asked_for(spark):
    audit = analyze_pages(_fetched(spark, [("a", "<p>kept text</p>", None, True), ("b", "", None, True)]), Settings())
    assert extracted_texts_table(audit, Settings()).count() == 0
    got = extracted_texts_table(audit, Settings(save_extracted_text=True)).collect()
    assert [(r["url"], r["extracted_text"]) for r in got] == [("a", "kept text")]
