import random

import pytest

from atticwork.llm import url_filter

SCHEMA = "page_id long, url string, rule int, host double, html string"
RULES = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = lower(rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = {}
    for h, p, v in rules:
        h, p = lower(h or ""), p or ""
        if v and (not h or host == h or host.endswith("." + h)) and path.startswith(p):
            fit[h, p] = "block" if "block" in (v, fit.get((h, p))) else "allow"
    if not fit:
        return host, path, None, default
    best = max(fit, key=lambda k: (len(k[0]), len(k[1])))
    return host, path, best[0] + best[1], fit[best]


URLS = [
    None, "", "no scheme.com/", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/1?q=/es/", "https://example.com/en", "https://example.com/en/",
    "https://a.example.com/en/x#y", "http://www.example.com/en/x", "http://xwww.example.com/en/x", "http://notexample.com/en/1", "http://x.net/es/", "http://x.net/esp/",
    "http://x.net?/es/", "http://x.net#/fr/", "http://a://b.net/fr/", "http://example.com:80/en/", "http://u@example.com/en/", "http://.com/", "http://a..com/", "http://com./",
    "ftp://é.NET/fr/ü", "http://x.net/fr/", "http://İ.com/EN/", "http://x.net/" + "fr/" * 30_000, "http://" + "a." * 30_000 + "net/es/", "http://x.net/\n/fr/",
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, 7, 0.5, "<p>") for i, u in enumerate(urls)], SCHEMA)


def check(spark, urls, rules, **how):
    found = url_filter.judge(pages(spark, urls), spark.createDataFrame(rules, RULES), **how)
    assert found.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert got == {i: brute(u, rules, how.get("default", "allow")) for i, u in enumerate(urls)}


@pytest.mark.parametrize("most", [100, 0])
def test_rules_of_the_query(spark, most):
    check(spark, URLS + URLS[-6:], url_filter.RULES, most_rules=most)


@pytest.mark.parametrize("most", [100_000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_rules(spark, most, seed):
    turn = random.Random(seed)
    label = lambda: turn.choice(["a", "b", "com", "net", ""])
    part = lambda: turn.choice(["", "x", "xy", "y", "x/", "/"])
    host = lambda: ".".join(label() for _ in range(turn.randrange(1, 4)))
    path = lambda: turn.choice(["", "/"]) + "/".join(part() for _ in range(turn.randrange(0, 4)))
    rules = [(host().upper(), path(), turn.choice(["allow", "block"])) for _ in range(60)]
    rules += [(None, None, "block"), ("a", None, None), ("A", "/x", "allow"), ("a", "/x", "block")]
    urls = [f"http://{host()}/{path()}" for _ in range(400)]
    check(spark, urls, rules, most_rules=most)
    check(spark, urls, rules[:20], most_rules=most, default="block")


def test_no_rows_no_rules_wrong_rules(spark):
    rules = spark.createDataFrame(url_filter.RULES, RULES)
    assert url_filter.judge(pages(spark, URLS).limit(0), rules).collect() == []
    for most in (0, 10):
        assert {r.verdict for r in url_filter.judge(pages(spark, URLS), rules.limit(0), default="block", most_rules=most).collect()} == {"block"}
    with pytest.raises(ValueError):
        url_filter.judge(pages(spark, URLS), spark.createDataFrame([("a", "/", "maybe")], RULES))


def test_trie_has_one_node_per_label_and_segment():
    trie = url_filter.UrlTrie([("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("com", "/", "allow")])
    assert trie._nodes == 1 + 3 + 5
    assert trie.rules[trie.match("x.www.example.com", "/en/1")] == ("www.example.com/en/", "allow")
    assert trie.match("org", "/") is None
