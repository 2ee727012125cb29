"""URL12 with a suffix table."""

from lexaudit.operators.suffixes import suffix_rules, with_registered_domain

RULES = """// a comment
com
uk
co.uk  trailing words
jp
*.kawasaki.jp
!city.kawasaki.jp
.github.io
COM
"""


def domains(spark, hosts, rules=RULES):
    table = None
    if rules is not None:
        table = suffix_rules(spark.createDataFrame([(x,) for x in rules.split("\n")] + [(None,)], "value string"))
    df = spark.createDataFrame([(k, h) for k, h in enumerate(hosts)], "k int, host string")
    rows = with_registered_domain(df, "host", "rd", table).orderBy("k").collect()
    assert [r.k for r in rows] == list(range(len(hosts)))
    return [r.rd for r in rows]


def test_rules_wildcards_and_exceptions(spark):
    want = {"a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "x.uk": "x.uk", "a.x.uk": "x.uk", "a.b.github.io": "b.github.io",
            "www.city.kawasaki.jp": "city.kawasaki.jp", "city.kawasaki.jp": "city.kawasaki.jp",
            "a.b.other.kawasaki.jp": "b.other.kawasaki.jp", "WWW.Example.COM.": "example.com", "a.b.example.com": "example.com"}
    assert domains(spark, list(want)) == list(want.values())


def test_fallback_where_no_rule_matches(spark):
    hosts = ["a.b.unknown", "192.168.0.1", "localhost", "", None, "a.b.or.jp"]
    assert domains(spark, hosts) == ["b.unknown", "192.168.0.1", "localhost", "", "", "or.jp"]
    assert domains(spark, hosts, None) == ["b.unknown", "192.168.0.1", "localhost", "", "", "b.or.jp"]


def test_many_rules_and_one_hot_host(spark):
    rules = "\n".join(f"z{k}.net" for k in range(3000))
    hosts = ["a.b.z7.net"] * 500 + [f"q.w{k}.z{k}.net" for k in range(300)]
    got = domains(spark, hosts, rules)
    assert got[:500] == ["b.z7.net"] * 500 and got[500:] == [f"w{k}.z{k}.net" for k in range(300)]
