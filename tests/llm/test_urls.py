import fnmatch
import random
import re

import pyarrow as pa
import pytest

from tessella.llm.urls import BASE_RULES, Automaton, UrlRule, filter_urls

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://com/en/", "http://xcom/en/", "https://www.example.net/de/81", "https://e.net/de/8", "https://e.org/es/", "https://e.org/es", "http://e.org/x.com/en/", "a://b://c.com/en/1", "http://spam-farm.example.org/en/1", "http://www.cheap-pills.example.com/xx", "http://h.com?x/en/", "http://ÜMLAUT.org/es/ü", "http://x.org/es/\nline"]


def parsed(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def base(host, path):
    best = None
    for h, p, v in (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def test_contract(spark):
    rows = filter_urls(spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, rule string")).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        assert (r.host, r.path) == parsed(r.url)
        want = base(r.host, r.path)
        assert r.rule == (want and want[0])
        assert r.verdict == (want[1] if want else "block" if r.host in ("a.free-bets.biz", "ads-track.io", "spam-farm.example.org", "www.cheap-pills.example.com") else "allow")


def regex(glob):
    return re.compile("(?s)" + re.escape(glob).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + r"\Z")


@pytest.mark.parametrize("seed", range(3))
def test_automaton_against_regular_expressions(seed):
    rng = random.Random(seed)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "?", "**", "ab"]) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randrange(0, 12))) for _ in range(200)]
    got = Automaton([UrlRule(g, "block") for g in globs]).matches(pa.array(texts))
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert got[i, j] == bool(regex(g).match(t)), (g, t)


def test_rules_without_wildcards_cross_word_borders():
    long = "/" + "x" * 200
    got = Automaton([UrlRule(long, "block"), UrlRule("a", "block"), UrlRule("", "block")]).matches(pa.array([long, long + "x", "a", ""]))
    assert got.tolist() == [[True, False, False], [False, False, False], [False, True, False], [False, False, True]]
    assert fnmatch.fnmatch("a", "a") and len(BASE_RULES) == 5


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([("http://a.com/en/",)] * 3, "url string")
    assert [r.rule for r in filter_urls(df).collect()] == ["com/en/"] * 3
    assert filter_urls(df.where("false")).count() == 0
    assert {r.verdict for r in filter_urls(df, [], "block").collect()} == {"block"}
