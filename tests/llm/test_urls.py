import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.llm.urls import compile_pattern, index_patterns, judge_urls, match_patterns

URLS = ["http://ads.x.com/a", "https://www.casino-win.example.com/en/1", "http://a.b/casino", None, "no scheme",
        "HTTP://UP.Example.NET/en/A?x#y", "http://example.net/en/", "http://example.net/de/", "http://net/a",
        "http://net", "http://xnet/a", "ftp://a.example.com/de/z", "http://a.org/fr/x", "http://a.org/fr", "://h/p",
        "http://h?q=/p#://", "http://h#f", "http://ads-track.org/", "http://x.ads-track.net/a/b?c",
        "http://e.com/pixel.gif", "http://e.com/pixel.gif?x", "http://e.com/a&click_id=3"]


def plain(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = host.lower()
    best = None
    for verdict, rule in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
                          ("allow", "org/fr/")):
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, best


def test_rules_and_parts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    for r in judge_urls(pages).collect():
        host, path, best = plain(r["url"])
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (best[0] if best else None)
        assert r["verdict"] == (best[1] if best else "block" if r["pattern"] else "allow")


PATTERNS = ["||casino-win.", "||ads.", "|http://ads.", "/pixel.gif|", "&click_id=", "cas*win", "^de^", "*", "a", "||h^"]


def test_index_finds_what_all_patterns_find(spark):
    rng = random.Random(0)
    urls = [u for u in URLS] + ["http://" + "".join(rng.choice("ads.-/casinowin?de") for _ in range(20)) for _ in range(300)]
    for patterns in (PATTERNS, [p for p in PATTERNS if p not in ("*", "a")]):
        rows = match_patterns(spark.createDataFrame([(u,) for u in urls], "url string"), patterns).collect()
        parsed = sorted((compile_pattern(p) for p in patterns), key=lambda p: p.text)
        for r in rows:
            fits = [p.text for p in parsed if r["url"] is not None and re.search(p.regex, r["url"].lower(), re.S)]
            assert r["pattern"] == (fits[0] if fits else None)


def test_rarest_token_is_the_key():
    parsed = [compile_pattern("||casino-win."), compile_pattern("cas*win")]
    index, always = index_patterns(parsed, {"casino": 9, "win": 2})
    assert list(index) == ["win"] and [p.text for p in always] == ["cas*win"]


def test_empty_repeated_and_clashing(spark):
    schema = "page_id long, url string, host int, verdict int"
    assert judge_urls(spark.createDataFrame([], schema)).count() == 0
    got = judge_urls(spark.createDataFrame([(1, "http://a.net/x", 5, 6)] * 3, schema)).collect()
    assert [(r["host"], r["verdict"]) for r in got] == [("a.net", "block")] * 3
    assert judge_urls(spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string"),
                      patterns=()).first()["verdict"] == "allow"
