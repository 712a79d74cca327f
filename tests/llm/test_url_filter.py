"""URL filters: rules against a loop over all of them, aliases against a plain search."""

import random
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from corpusaudit.llm import url_filter

SCHEMA = "page_id long, url string, html string, host string, rule string, key string, target string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def rules_of(spark, rows):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:end]


def best_rule(url, rules):
    host, path = parts(url)
    fits = [(h, p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", -len(r[0]), r[0] + r[1]), default=None)


def expected(pages, rules, edges):
    key = lambda u: urldefrag(u).url
    near, urls = {}, {u for _, u, _ in pages if u}
    for a, b in edges:
        urls |= {b}
        near.setdefault(key(a), set()).add(key(b))
        near.setdefault(key(b), set()).add(key(a))
    bad = {key(u) for u in urls if (r := best_rule(u, rules)) and r[2] == "block"}
    todo = list(bad)
    while todo:
        for v in near.get(todo.pop(), ()):
            if v not in bad:
                bad.add(v)
                todo.append(v)
    out = []
    for i, u, _ in pages:
        r = best_rule(u, rules)
        verdict = r[2] if r else "block" if u and key(u) in bad and key(u) in near else "allow"
        out.append((i, *parts(u), r[0] + r[1] if r else None, verdict))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("broadcast", [True, False])
def test_random_rules_and_links(spark, monkeypatch, seed, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_filter, "fits_broadcast", lambda df: False)
    rng = random.Random(seed)
    hosts = ["a.net", "b.a.net", "xa.net", "c.org", "d.c.org", "e.com"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['', 'p', 'p/1', 'q', 'q/22'])}{rng.choice(['', '?x=1', '#f'])}" for _ in range(60)]
    rules = list({(rng.choice([*hosts, "net", "org", "t"]), rng.choice(["/", "/p", "/p/1", "/q/2", ""])): rng.choice(["allow", "block"]) for _ in range(7)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    edges = [(rng.choice(urls), rng.choice([rng.choice(urls), f"https://t{rng.randrange(9)}.t/x"])) for _ in range(25)]
    link = {}
    for a, b in edges:
        link.setdefault(a, []).append(b)
    pages = [(i, u, "".join(f'<link rel="canonical" href="{b}">' for b in link.get(u, []))) for i, u in enumerate(urls)]
    assert got(url_filter.filter_urls(pages_of(spark, pages), rules_of(spark, rules))) == expected(pages, rules, edges)
    bare = [(i, u, "") for i, u, _ in pages]
    redirects = spark.createDataFrame(edges, "source string, target string")
    assert got(url_filter.filter_urls(pages_of(spark, bare), rules_of(spark, rules), redirects)) == expected(pages, rules, edges)


def test_hub_and_chain(spark):
    """A third of all pages name one address, and a chain of redirects ends at a blocked one that is no page."""
    pages = [(i, f"https://h{i}.net/", '<LINK href="https://hub.net/x" REL=canonical>') for i in range(300)]
    pages += [(1000 + i, f"https://c{i}.net/", f'<meta http-equiv="refresh" content="0; url=https://c{i + 1}.net/">') for i in range(40)]
    pages += [(2000, "https://hub.net/x", ""), (2001, "https://ok.org/", '<link rel="canonical" href="https://hub.net/x">'), (2002, "https://alone.net/", "")]
    rules = [("c40.net", "/", "block"), ("ok.org", "/", "allow"), ("h7.net", "/", "block")]
    out = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages_of(spark, pages), rules_of(spark, rules)).collect()}
    assert all(out[i] == "block" for i in [*range(300), *range(1000, 1040), 2000])
    assert out[2001] == "allow" and out[2002] == "allow"


@pytest.mark.parametrize("base", ["http://a.net/x/y?q=1", "https://a.net", "http://a.net/x/"])
def test_resolved_as_a_browser_does(spark, base):
    targets = ["z", "/z", "../z", "./z", "z/", "../../../z", "?p=2", "#f", "//b.org/k", "https://b.org/k#g", "z/../w", ".", "..", "/a/./b/../c", "k?x=/../1"]
    df = spark.createDataFrame([(t,) for t in targets], "t string").select("t", url_filter.url_key(url_filter.resolve_url(F.lit(base), F.col("t"))).alias("u"))
    want = {t: urldefrag(urljoin(base if base.count("/") > 2 else base + "/", t)).url for t in targets}
    assert {r["t"]: r["u"] for r in df.collect()} == want
    odd = spark.createDataFrame([("mailto:x@y",), ("javascript:void(0)",), ("",)], "t string")
    assert [r[0] for r in odd.select(url_filter.resolve_url(F.lit(base), F.col("t"))).collect()] == [None] * 3


def test_links_in_markup(spark):
    html = {
        1: "<!-- <link rel=canonical href=https://no.net/> --><link rel='alternate canonical' href='/a&amp;b'>",
        2: "<script>var x='<link rel=canonical href=https://no.net/>'</script><link href=c rel=canonical>",
        3: '<link rel="stylesheet" href="/s"><link data-href="/n" rel="canonical"><meta name="refresh" content="0;url=/n">',
        4: '<meta content="5; URL=\'https://t.org/\'" http-equiv=Refresh><meta http-equiv="refresh" content="30">',
        5: "<!-- canonical " + "<!--" * 50_000,
        6: "<link " * 50_000 + "canonical",
        7: None,
    }
    pages = pages_of(spark, [(i, f"http://p{i}.net/d/x", h) for i, h in html.items()])
    found = sorted(map(tuple, url_filter.page_links(pages).collect()))
    assert found == [("http://p1.net/d/x", "http://p1.net/a&b"), ("http://p2.net/d/x", "http://p2.net/d/c"), ("http://p4.net/d/x", "https://t.org/")]


def test_odd_addresses(spark):
    urls = [None, "", "no scheme", "HTTP://ORG.example.ORG/es/1", "http://org", "http://org?x", "x://org/", "x://.org/", "http://" + "a." * 5000 + "org/", "http://é.ORG/É", "a://b://org/"]
    pages = [(None if i == 3 else i // 2, u, None) for i, u in enumerate(urls * 2)]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("org", "/es/", "block")]
    with_null = [*rules, (None, "/", "block"), ("org", None, "block"), ("org", "/", None), rules[0]]
    out = url_filter.filter_urls(pages_of(spark, pages), rules_of(spark, with_null))
    assert got(out) == expected(pages, rules, [])
    assert got(url_filter.filter_urls(pages_of(spark, pages), rules_of(spark, []))) == expected(pages, [], [])
    assert got(url_filter.filter_urls(pages_of(spark, [pages[0]]).limit(0), rules_of(spark, rules))) == []


def test_equally_long_rules(spark):
    rules = [("b.net", "/a", "block"), ("net", "/abc", "allow"), ("net", "/d", "block"), ("c.net", "/d", "allow")]
    pages = [(1, "x://b.net/abc", ""), (2, "x://c.net/d", "")]
    assert [r[3:] for r in got(url_filter.filter_urls(pages_of(spark, pages), rules_of(spark, rules)))] == [("net/abc", "allow"), ("c.net/d", "allow")]


def test_no_python_in_the_plan(spark):
    pages = pages_of(spark, [(1, "http://a.net/", '<link rel="canonical" href="/b">')])
    plan = url_filter.filter_urls(pages, rules_of(spark, [("net", "/", "block")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
