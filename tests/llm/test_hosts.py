import math

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import hosts, queries

RULES = queries.URL_RULES


def test_parts_and_rules(spark):
    cases = [
        ("http://A.Example.COM/En/x?q=1#f", "a.example.com", "/En/x", "com/"),
        ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/"),
        ("https://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/"),
        ("https://notwww.example.com/en/1", "notwww.example.com", "/en/1", "example.com/en/"),
        ("https://example.com/en", "example.com", "/en", "com/"),
        ("https://badexample.com/en/", "badexample.com", "/en/", "com/"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/"),
        ("http://x.net/fr/", "x.net", "/fr/", "net/fr/"),
        ("http://net/fr/", "net", "/fr/", "net/fr/"),
        ("http://x.org/en/", "x.org", "/en/", None),
        ("http://com", "com", "", None),
        ("http://x.com?a=/en/", "x.com", "", None),
        ("a://b://c/d", "b:", "//c/d", None),
        ("no scheme", "", "", None),
        (None, "", "", None),
        ("", "", "", None),
        ("x\ny://ÄB.com/p\nq", "Äb.com", "/p\nq", "com/"),
    ]
    df = spark.createDataFrame([(u,) for u, *_ in cases], "url string").withColumn("n", F.monotonically_increasing_id())
    host, path = hosts.host_of(F.col("url")), hosts.path_of(F.col("url"))
    got = df.select("url", host.alias("h"), path.alias("p"), hosts.rule_for(RULES, host, path).alias("r")).collect()
    assert sorted(map(repr, [(r.url, r.h, r.p, r.r) for r in got])) == sorted(map(repr, cases))


def test_domains(spark):
    row = spark.range(1).select(
        *[hosts.domain_of(F.lit(h)).alias(f"d{k}") for k, h in enumerate(("a.b.example.com", "x.co.uk", "a.x.co.uk", "com", ""))],
        hosts.suffix_of(F.lit("a.x.co.uk")).alias("s"),
    ).first()
    assert tuple(row) == ("example.com", "x.co.uk", "x.co.uk", "com", "", "co.uk")


def strength(children):
    told = [(n, g, m) for n, g, m in children if n > 0 and m is not None and 0 < m < 1]
    pairs = sum(n - 1 for n, _, _ in told)
    excess = sum((g - n * m) ** 2 / (n * m * (1 - m)) for n, g, m in told) - len(told)
    if not pairs or excess <= 0:
        return 1e6
    return min(max(1 / min(excess / pairs, 1) - 1, 1.0), 1e6)


def test_shrinkage_same_as_model(spark):
    counts = {
        "a.one.com": (40, 2), "b.one.com": (30, 3), "c.one.com": (0, 0), "a.two.com": (50, 48), "b.two.com": (3, 0),
        "x.three.org": (20, 18), "y.three.org": (1, 1), "only.net": (0, 0),
    }
    rows = [(h, int(k < g)) for h, (n, g) in counts.items() for k in range(n)] + [(h, None) for h in counts] * 3
    got = {r.host: r for r in hosts.reputations(spark.createDataFrame(rows, "host string, good int")).collect()}

    def pooled(key):
        made = {}
        for h, (n, g) in counts.items():
            a, b = made.get(key(h), (0, 0))
            made[key(h)] = a + n, b + g
        return made

    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    n, g = map(sum, zip(*counts.values()))
    mean = {"": g / n}
    post = {"": g / n}
    last = {"": n}
    for key, parent in ((suffix, lambda h: ""), (domain, suffix), (lambda h: h, domain)):
        made = pooled(key)
        m = strength([(made[k][0], made[k][1], mean[parent(k)]) for k in made])
        own = {k: max(1.0, min(m, last[parent(k)])) for k in made}
        new = {k: (own[k] * post[parent(k)] + made[k][1]) / (own[k] + made[k][0]) for k in made}
        mean = {**mean, **{k: made[k][1] / made[k][0] if made[k][0] else None for k in made}}
        post = {**post, **new}
        last = {k: own[k] + made[k][0] for k in made}
    for h in counts:
        assert got[h].posterior == pytest.approx(post[h])
        p = post[h]
        assert got[h].upper == pytest.approx(p + 1.645 * math.sqrt(p * (1 - p) / (last[h] + 1)))
    assert got["a.one.com"].upper < 0.5 < got["a.two.com"].upper
    assert got["c.one.com"].posterior < got["x.three.org"].posterior


def test_bad_hosts_are_blocked_unless_a_rule_fits(spark):
    rows = [(i, f"http://bad.org/p/{i}", i, "z") for i in range(40)] + [(i, f"http://good.net/p/{i}", i, "z") for i in range(40, 80)]
    rows += [(100, "http://x.bad.org/p/", None, "z"), (101, None, None, "z"), (102, "http://bad.com/p/1", None, "z"), (0, "http://bad.org/p/0", 0, "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, key bigint, host string").withColumn("good", F.lit("w"))
    outcomes = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)] + [(3, None), (None, 1)], "key bigint, good int")
    got = hosts.judge(pages, outcomes, RULES).collect()
    assert len(got) == len(rows)
    verdict = {r.page_id: r.verdict for r in got}
    assert all(verdict[i] == "block" for i in range(40)) and all(verdict[i] == "allow" for i in range(40, 80))
    assert verdict[102] == "allow" and verdict[101] == "allow"
    none = hosts.judge(pages, outcomes.filter("false"), RULES).collect()
    assert {r.verdict for r in none} == {"allow"} and hosts.judge(pages.filter("false"), outcomes, RULES).collect() == []


def test_one_bad_host_among_many(spark):
    """Hosts that are nearly all alike don't keep a wholly bad one from being blocked."""
    good = spark.range(1000 * 30).select(F.format_string("h%d.com", F.col("id") % 1000).alias("host"), (F.xxhash64("id") % 100 < 72).cast("int").alias("good"))
    shared = spark.range(500 * 30).select(F.format_string("s%d.shared.com", F.col("id") % 500).alias("host"), (F.xxhash64("id") % 100 < 72).cast("int").alias("good"))
    bad = spark.range(60).select(F.expr("if(id < 30, 'bad.com', 'bad.shared.com')").alias("host"), F.lit(0).alias("good"))
    judged = good.unionByName(shared).unionByName(bad)
    found = {r.host: r.upper for r in hosts.reputations(judged, most_prior_pages=hosts.MOST_PRIOR_PAGES).collect()}
    assert {host for host, upper in found.items() if upper < hosts.MIN_GOOD} == {"bad.com", "bad.shared.com"}


def test_levels_of_ports_addresses_and_listed_suffixes(spark):
    cases = {
        "example.com:8080": ("example.com", "com"), "me:secret@a.example.com": ("example.com", "com"), "example.com.": ("example.com", "com"),
        "10.0.0.1:80": ("10.0.0.1", ""), "[::1]:80": ("[::1]", ""), "a.b.co.il": ("b.co.il", "co.il"), "x.y.github.io": ("y.github.io", "github.io"),
        "a.b.c.city.kawasaki.jp": ("c.city.kawasaki.jp", "city.kawasaki.jp"), "a.b.io": ("b.io", "io"), "github.io": ("github.io", "github.io"), "": ("", ""),
    }
    listed = ["co.il", "github.io", "city.kawasaki.jp", "io"]
    df = spark.createDataFrame([(h,) for h in cases], "host string")
    got = df.select("host", hosts.domain_of(F.col("host"), listed).alias("d"), hosts.suffix_of(F.col("host"), listed).alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in got} == cases
