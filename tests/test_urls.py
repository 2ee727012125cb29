"""URL algebra: rule table per reason, and differential tests against the
standard library's parser and joiner."""

import random
from pathlib import PurePosixPath
from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlunparse

from pyspark.sql import functions as F

from lexaudit.functions import urls as U
from lexaudit.operators.urls import classify_urls


def py_normalize(raw, exclude_pdf=True):
    """Stdlib model of URL1 (test oracle)."""
    value = raw.strip()
    if not value:
        return "", "empty_value"
    try:
        p = urlparse(value)
    except ValueError:
        return "", "invalid_url"
    scheme = p.scheme.lower()
    if scheme in ("mailto", "tel", "javascript"):
        return "", f"unsupported_scheme:{scheme}"
    if scheme not in ("http", "https") or not p.netloc:
        return "", "invalid_url"
    net = p.netloc.lower()
    if scheme == "http" and net.endswith(":80"):
        net = net[:-3]
    if scheme == "https" and net.endswith(":443"):
        net = net[:-4]
    path = p.path
    if not path or path == "/":
        path = ""
    else:
        path = path.rstrip("/") if path.endswith("/") else path
        if not path.startswith("/"):
            path = "/" + path
    suffix = PurePosixPath(path).suffix.lower() if path else ""
    exts = set(U.NON_HTML_EXTENSIONS) - ({".pdf"} if not exclude_pdf else set())
    if suffix in exts:
        return urlunparse((scheme, net, path, "", "", "")), "non_html_extension"
    q = urlencode([(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True)
                   if k.lower() not in ("fbclid", "gclid")], doseq=True)
    return urlunparse((scheme, net, path, "", q, "")), None


CASES = [
    "", "   ", "mailto:a@b.c", "TEL:123", "javascript:void(0)", "ftp://x.org/a", "http:/x", "//x.org/a",
    "HTTP://Example.COM:80/a/b/", "https://x.org:443", "https://x.org:8443/", "http://x.org//",
    "http://x.org/a;params?x=1", "http://x.org/a.PDF?x=1", "http://x.org/a.jpeg", "http://x.org/.pdf",
    "http://x.org/a?fbclid=1&b=2&GCLID=3&utm_source=z", "http://x.org/a?a=%zz&b&c=1 2&d=~*",
    "http://x.org/p?&&a=1&", "http://x.org/a b/c", "http://x.org/a#frag", "http://x.org/a/b.html/",
    "https://user@X.org:443/a", "http://x.org/a?q=%E3%81%82+b", "http://[::1/a",
]


def test_normalize_rule_table(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, u string")
    out = U.with_normalized_url(df, "u").orderBy("i").collect()
    for row in out:
        exp = py_normalize(row["u"])
        assert (row["normalized_url"], row["skip_reason"]) == exp, row["u"]


def _rand_url(rng):
    hosts = ["a.example.com", "B.Example.org:80", "c.example.net:443", "d.example.com:8080"]
    segs = ["x", "y.html", "z.pdf", "", "a b", "%41", "~u", "q;p"]
    path = "/".join(rng.choice(segs) for _ in range(rng.randint(0, 3)))
    qs = "&".join(rng.choice(["a=1", "fbclid=2", "b", "c=", "d=%zz", "e=1+2", "f=*~"]) for _ in range(rng.randint(0, 3)))
    u = f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice(hosts)}/{path}"
    if qs:
        u += "?" + qs
    if rng.random() < 0.3:
        u += "#f"
    return u


def test_normalize_differential(spark):
    rng = random.Random(7)
    urls = [_rand_url(rng) for _ in range(400)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    out = U.with_normalized_url(df, "u").collect()
    for row in out:
        assert (row["normalized_url"], row["skip_reason"]) == py_normalize(row["u"]), row["u"]


def test_resolve_differential(spark):
    rng = random.Random(11)
    bases = ["http://h.example.com/a/b/c", "https://h.example.com/a/b/", "http://h.example.com",
             "http://h.example.com/a?x=1#f", "https://h.example.com/"]
    refs = ["", "#frag", "?q=1", "//cdn.example.com/x", "/a/./b/../c", "d/e", "../f", "./g/", "..", ".",
            "../../../x", "g?y#s", "https://o.example.com/p", "mailto:x@y.z", "/", "a//b/../c", "http:g"]
    pairs = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(pairs, "b string, r string")
    out = U.with_resolved_url(df, "b", "r", "j").collect()
    for row in out:
        assert row["j"] == urljoin(row["b"], row["r"]), (row["b"], row["r"])


def test_registered_domain_rules(spark):
    cases = {"a.b.example.co.jp": "example.co.jp", "www.example.com": "example.com",
             "example.com": "example.com", "10.0.0.1": "10.0.0.1", "x.gov.uk": "x.gov.uk",
             "a.x.gov.uk": "x.gov.uk", "localhost": "localhost", "a.b.c.d": "c.d"}
    df = spark.createDataFrame(list(cases.items()), "h string, e string")
    for row in df.select("e", U.registered_domain(F.col("h")).alias("r")).collect():
        assert row["r"] == row["e"]


def py_classify(urls, patterns, cap):
    targets, skipped, seen = [], [], set()
    for pos, raw in urls:
        norm, reason = py_normalize(raw)
        if reason is None:
            hit = next((p for p in patterns if p in norm), None)
            if hit is not None:
                reason = f"exclude_pattern:{hit}"
        if reason is None and norm in seen:
            reason = "duplicate_url"
        if reason is None and cap is not None and len(targets) >= cap:
            reason = f"max_urls_exceeded:{cap}"
        if reason is None:
            seen.add(norm)
            targets.append(pos)
        else:
            skipped.append((pos, reason))
    return targets, dict(skipped)


def test_classify_matches_sequential(spark):
    rng = random.Random(3)
    pool = [_rand_url(rng) for _ in range(30)] + ["", "mailto:x@y.z"]
    urls = [(i, rng.choice(pool)) for i in range(300)]
    df = spark.createDataFrame([("s", p, u) for p, u in urls], "site_id string, input_pos long, original_url string")
    for cap in (None, 7):
        out = classify_urls(df, exclude_patterns=["/x/"], max_urls=cap).collect()
        t, s = py_classify(urls, ["/x/"], cap)
        assert sorted(r["input_pos"] for r in out if r["skip_reason"] is None) == t
        assert {r["input_pos"]: r["skip_reason"] for r in out if r["skip_reason"] is not None} == s
        assert len(out) == len(urls)
