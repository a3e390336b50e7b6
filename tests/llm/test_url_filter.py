"""URL filters against every rule compared with every url."""

from urllib.parse import quote

import pytest

from sonamark.llm import url_filter

ENTRIES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "example.net/en/ads"), ("allow", "example.net/en/ads/ok/"), ("block", "a.example.net/"),
           ("block", "whole.io"), ("allow", "Whole.IO/x"), ("block", "twice.io/"), ("allow", "twice.io/"), ("block", "example.net/en/ad"), (None, "null.io/"), ("block", None), ("block", "example.net/en/ads/b")]
URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://example.net/en/", "http://example.net/en", "http://x.Example.net/en/1?q=/de/#t", "http://example.net/en/ads", "http://example.net/en/adsense/9",
        "http://example.net/en/ads/ok/1", "http://example.net/en/ads/okay", "http://a.example.net/en/1", "http://b.a.example.net", "http://b.a.example.net/en/", "http://notexample.com/de/", "http://www.example.com/de/?x", "http://example.com/de#x", "http://org/fr/a/b/c",
        "http://whole.io", "http://whole.io?x=://net/", "http://u.whole.io/xyz", "http://whole.io:80/", "http://twice.io/", "http://null.io/", "ftp://.net/", "x://y://net/", "http://" + "a." * 2000 + "net/" + "s/" * 5000, "http://ÀÉ.example.net/en/ü", "http://example.net/en/\nads", "http://example.net/en/ads/b/c"]


def want(url):
    head, sep, rest = (url or "").partition("://")
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
    tail = rest[end:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    best = (-1, -1, "", None, "allow")
    for verdict, rule in ENTRIES:
        if rule is None or verdict is None:
            continue
        h, slash, p = rule.lower().partition("/")[0], "/" in rule, "/" + rule.partition("/")[2] if "/" in rule else ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best, (len(h), len(p), verdict, rule, verdict))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_longest_entry(spark, limit):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[8], "x", "y"), (3, URLS[3], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    entries = spark.createDataFrame(ENTRIES, "verdict string, rule string")
    got = url_filter.judge_urls(pages, entries, most_entries=limit).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted([(i, *want(u)) for i, u, _, _ in rows], key=key)


def test_empty(spark):
    entries = spark.createDataFrame(ENTRIES, "verdict string, rule string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.judge_urls(pages.limit(0), entries).count() == 0
    assert [tuple(r) for r in url_filter.judge_urls(pages, entries.limit(0)).collect()] == [(1, "a.net", "/", None, "allow")]


def test_many_entries_of_one_host(spark):
    entries = spark.createDataFrame([("block", f"a.b/p{quote(str(i))}") for i in range(5000)], "verdict string, rule string")
    pages = spark.createDataFrame([(i, f"http://x.a.b/p{i}x/q") for i in range(50)], "page_id long, url string")
    for limit in (10_000, 10):
        assert {r.page_id: r.rule for r in url_filter.judge_urls(pages, entries, most_entries=limit).collect()} == {i: f"a.b/p{i}" for i in range(50)}
