"""Robots decisions against the standard library's parser (the reference
delegates to it)."""

import random
from urllib.robotparser import RobotFileParser

from lexaudit.operators.robots import robots_decisions, robots_rules
from lexaudit.sources import derived as D

BODIES = {
    "http://a.example.com": D.ROBOTS_BODY_A,
    "http://b.example.com": D.ROBOTS_BODY_B,
    "http://c.example.com": ("User-agent: *\nDisallow: /private/\nAllow: /private/ok\n\n"
                             "User-agent: SiteKeywordAnalyzer\nDisallow: /only-us/\nDisallow:\n"),
    "http://d.example.com": "# nothing\n\nUser-agent: foo\nDisallow: /\n",
    "http://e.example.com": "User-agent: *\nDisallow: /a%7Eb/\nDisallow: /q?x=1\n",
}
PATHS = ["/", "/en/1", "/en/", "/fr/1x", "/fr/2", "/es", "/es/9", "/de/x", "/private/ok", "/private/no",
         "/only-us/p", "/a~b/c", "/a%7Eb/c", "/q?x=1", "/q?x=2", "/x#frag"]
UA = "SiteKeywordAnalyzer/1.0"


def test_decisions_match_robotparser(spark):
    bodies = spark.createDataFrame([(o, o + "/robots.txt", 200, b) for o, b in BODIES.items()],
                                   "origin string, robots_url string, source_status int, body string")
    urls = [o + p for o in BODIES for p in PATHS]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["allowed"] for r in robots_decisions(df, bodies, UA).collect()}
    for o, body in BODIES.items():
        rp = RobotFileParser()
        rp.parse(body.splitlines())
        for p in PATHS:
            assert got[o + p] == rp.can_fetch(UA, o + p), (o, p)


def test_status_policies(spark):
    bodies = spark.createDataFrame([
        ("http://s404.example.com", "x", 404, None), ("http://s403.example.com", "x", 403, None),
        ("http://s500.example.com", "x", 503, None), ("http://snone.example.com", "x", None, None)],
        "origin string, robots_url string, source_status int, body string")
    urls = ["http://s404.example.com/a", "http://s403.example.com/a", "http://s500.example.com/a",
            "http://snone.example.com/a", "mailto:x@y.z", "http://unknown.example.com/a"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: (r["allowed"], r["robots_decision"]) for r in robots_decisions(df, bodies, UA).collect()}
    assert got["http://s404.example.com/a"] == (True, "allowed_by_robots_txt")
    assert got["http://s403.example.com/a"] == (False, "blocked_by_robots_txt")
    assert got["http://s500.example.com/a"] == (True, "allowed_by_robots_txt")
    assert got["http://snone.example.com/a"] == (True, "allowed_by_robots_txt")
    assert got["mailto:x@y.z"] == (True, "robots_not_checked_invalid_url")


def test_ten_thousand_rules_of_one_origin(spark):
    """Rules nested in each other, repeated, and in no order of length."""
    rng = random.Random(4)
    o = "http://many.example.com"
    paths = ["/" + "/".join(str(rng.randint(0, 9)) for _ in range(rng.randint(1, 6))) for _ in range(10_000)]
    body = "User-agent: *\n" + "".join(f"{rng.choice(('Allow', 'Disallow'))}: {p}\n" for p in paths)
    bodies = spark.createDataFrame([(o, o + "/robots.txt", 200, body)],
                                   "origin string, robots_url string, source_status int, body string")
    urls = sorted({o + "/" + "/".join(str(rng.randint(0, 12)) for _ in range(rng.randint(0, 7))) for _ in range(3000)})
    d = robots_decisions(spark.createDataFrame([(u,) for u in urls], "url string"), bodies, UA)
    got = {r["url"]: r["allowed"] for r in d.collect()}
    rp = RobotFileParser()
    rp.parse(body.splitlines())
    assert got == {u: rp.can_fetch(UA, u) for u in urls}
    assert {True, False} == set(got.values())


def test_agents_keep_the_order_of_the_file(spark):
    names = [f"agent{k}" for k in (3, 1, 2, 9, 0)]
    body = "".join(f"User-agent: {n}\n" for n in names) + "Disallow: /x\n"
    rows = robots_rules(spark.createDataFrame([("http://o.example.com", "r", 200, body)],
                                              "origin string, robots_url string, source_status int, body string")).collect()
    assert [r.agents for r in rows] == [names]
