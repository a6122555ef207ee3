"""Verdicts on urls against a search through all rules."""

import random

import pytest

from themeloom.llm import url_filter

LABELS = ["a", "b", "ab", "", "xn--a"]
SEGMENTS = ["", "x", "xy", "y", "x.html"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:at], rest[at:]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def longest(url, rules):
    host, path = split(url)
    fits = []
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h.split(".")) if h else 0, len(p), v == "block", h + p, v))
    best = max(fits, default=None)
    return (host, path, best[3] if best else None, best[4] if best else "allow")


def random_rule(rng):
    host = ".".join(rng.choice(["a", "b", "ab"]) for _ in range(rng.randint(0, 3)))
    path = "".join("/" + rng.choice(["", "x", "xy"]) for _ in range(rng.randint(0, 3)))
    return host, path, rng.choice(["allow", "block"])


def random_url(rng):
    host = ".".join(rng.choice(LABELS) for _ in range(rng.randint(1, 4)))
    path = "".join("/" + rng.choice(SEGMENTS) for _ in range(rng.randint(0, 4)))
    return rng.choice(["http", "HTTP", ""]) + "://" + host + path + rng.choice(["", "?q=/a", "#t", "?"])


@pytest.mark.parametrize("seed", range(30))
def test_trie_finds_the_longest_rule(seed):
    rng = random.Random(seed)
    rules = [random_rule(rng) for _ in range(rng.randint(0, 40))]
    trie = url_filter.build_trie(rules)
    for _ in range(200):
        url = random_url(rng)
        host, path = split(url)
        found = trie.find(trie.hosts(host), path)
        assert (found or (0, 0, None, "allow"))[2:] == longest(url, rules)[2:], (url, rules)


ODD = [None, "", "no scheme", "http://", "://a", "HTTP://A.B/X", "http://É.b/", "http://b", "http://b/", "http://b?x=/y",
       "http://u@b:80/x", "a://b://b/x", "http://b/x#://c/", "http://" + "a." * 20_000 + "b/" + "x/" * 50_000, "http://a\nb/x"]


@pytest.mark.parametrize("trie_bytes", [1, url_filter.TRIE_BYTES])
def test_pages(spark, trie_bytes):
    rng = random.Random(1)
    rules = [random_rule(rng) for _ in range(30)] + [("B", None, "block"), (None, "/zz", "block"), ("b", None, "allow")]
    urls = ODD * 2 + [random_url(rng) for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, HOST string")
    judged = url_filter.judge(pages, spark.createDataFrame(rules, url_filter.RULES), trie_bytes=trie_bytes)
    assert judged.columns == ["page_id", "url", "HOST", "_host", "path", "rule", "verdict"]
    rows = sorted(judged.collect())
    assert [r["HOST"] for r in rows] == ["mine"] * len(urls)
    assert [(r["_host"], r["path"], r["rule"], r["verdict"]) for r in rows] == [longest(u, rules) for u in urls]


def test_no_pages_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], url_filter.RULES)
    assert url_filter.judge(pages.limit(0), none).collect() == []
    verdicts = url_filter.judge(pages, none, default="block").select("page_id", "host", "rule", "verdict").collect()
    assert sorted(verdicts, key=str) == [(1, "a.b", None, "block"), (None, "", None, "block")]
    with pytest.raises(ValueError, match="allow or block"):
        url_filter.judge(pages, spark.createDataFrame([("a", "/", "maybe")], url_filter.RULES))
