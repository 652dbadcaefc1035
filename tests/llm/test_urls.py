import math
import os
import re

from assetlens.llm import urls

SF = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.01")


def plain(url):
    """Host, path and rule, written out."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = []
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_given_pages_equal_brute_force(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    got = urls.op9_urls(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= urls.BLOCK_FROM else "allow"))
    assert {r.rule for r in got} >= {"com/", "example.com/en/", None}


def test_odd_urls(spark):
    odd = [
        None, "", "x", "no scheme/en/", "http://", "http://COM/", "http://com", "http://com?x", "http://acom/", "http://a.com/", "http://example.com/en/",
        "http://example.com/EN/", "http://WWW.Example.com/en/x?y#z", "http://a.www.example.com/en/", "http://xexample.com/en/", "ftp://u@b.net:80/es/", "b.net://c.net/fr/a",
        "http://a.net/es", "http://a.net/es/#/fr/", "http://a.net#/es/", "http://net/fr/", "a://b://c.net/es/", "http://É.NET/es/", "http://a\nb.net/fr/", "http://a.net/fr/" + "x" * 100_000,
    ]
    df = spark.createDataFrame([(i if i else None, u, "h", 1.0) for i, u in enumerate(odd)], "page_id long, url string, host string, score double")
    none = spark.createDataFrame([], "labelled_page long, blocked int")
    got = {r.page_id or 0: r for r in urls.judged(df, none).collect()}
    assert len(got) == len(odd)
    for i, u in enumerate(odd):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u


def test_trees_learn_what_the_address_shows(spark):
    good = [(i, f"http://h{i % 40}.org/article/name-{'abcdef'[i % 6]}", 0) for i in range(300)]
    bad = [(1000 + i, f"http://q{i % 40}.org/{i * 7919 % 99991}/{i * 31 % 977}/{i}{i}?a={i}&b={i}&c=3", 1) for i in range(300)]
    rows = good + bad
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    known = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "labelled_page long, blocked int")
    got = {r.page_id: r for r in urls.judged(df, known).collect()}
    left = [r for r in rows if r[0] % 3 == 0]
    assert all(got[i].rule is None for i, _, _ in left)
    assert sum((got[i].verdict == "block") == bool(b) for i, _, b in left) / len(left) > 0.97


def test_features(spark):
    df = spark.createDataFrame([(1, "http://a.b.org/x/y?p=1&q=2#z"), (1, "http://a.b.org/x/y?p=1&q=2#z"), (2, None), (3, "http://c.org/")], "page_id long, url string")
    rows = urls.featured(df).collect()
    assert len(rows) == 4
    r = next(r for r in rows if r.page_id == 1)
    url = "http://a.b.org/x/y?p=1&q=2#z"
    entropy = -sum(url.count(c) / len(url) * math.log2(url.count(c) / len(url)) for c in set(url))
    assert (r.depth, r.parameters, r.host_labels) == (2.0, 2.0, 3.0) and abs(r.entropy - entropy) < 1e-9
    assert abs(r.digit_share - 2 / len(url)) < 1e-12 and abs(r.suffix_pages - math.log1p(3)) < 1e-12 and abs(r.suffix_hosts - math.log1p(2)) < 1e-12


def test_labels_by_document(spark):
    pages = spark.createDataFrame([(1, "http://a.org/en/7"), (2, "http://a.org/en/8.html?x=9"), (3, "http://a.org/"), (4, None), (5, "http://a.org/7x/9"), (1, "http://a.org/8")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (9, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, urls.labels_by_document(pages, labels).collect())) == [(1, 1), (2, 1), (5, 0)]


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judged(empty, spark.createDataFrame([], "labelled_page long, blocked int")).count() == 0
