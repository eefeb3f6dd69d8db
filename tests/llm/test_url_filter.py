import re
from collections import Counter

import pytest

from inkgraph.llm.url_filter import RULES, TERMS, Rules, judge_urls

URLS = [
    None, "", "no scheme", "http://", "http://a.org", "http://a.org/", "HTTP://User@Example.ORG:80/es/1?q=/x#y", "http://example.org/es/1", "http://sub.Example.org/en/19",
    "http://badexample.org/en/1", "http://x.com/fr/casino", "http://x.com/de/", "http://x.com/de", "http://casino-win.net/", "http://casinowin.net/", "http://free-bets.net/?free=free", "http://free.net/free%20pills",
    "http://a.net/?u=http://b.org/", "http://a.net#casino", "http://éfree-bets.net/winé", "ftp://.org/x", "http://a..org/x", "x://h" + "/free" * 40_000, "http://a.net/\nfree\npills", "http://a.net?x/y",
]


def plain(url, terms, rules, limit):
    host = path = ""
    if url and "://" in url:
        tail = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, path = tail.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
    fits = [(len(r), len(r.split("/")[0]), r, v) for r, v in rules if ("." + host).endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])]
    low = re.sub("%[0-9a-f]{2}", " ", re.sub("[A-Z]", lambda m: m[0].lower(), url or ""))
    hits = {t: len(re.findall(f"(?<![0-9a-z\x80-\U0010ffff]){re.escape(t)}(?![0-9a-z\x80-\U0010ffff])", low)) for t in terms}
    rule, verdict = max(fits)[2:] if fits else (None, "block" if sum(w for t, w in terms.items() if hits[t]) >= limit else "allow")
    return host, path, rule, verdict, sum(n for t, n in hits.items() if terms[t] >= limit), sum(n for t, n in hits.items() if terms[t] < limit), sum(n > 0 for t, n in hits.items() if terms[t] < limit)


@pytest.mark.parametrize(("terms", "rules", "limit"), [(TERMS, RULES, 2), ({"free-bets": 1.0, "bets": 0.5, "free": 0.5, "pills": 3}, [], 1.5), ({}, [("net/", "block"), ("a.net/", "allow")], 1)])
def test_verdicts_equal_plain_ones(spark, terms, rules, limit):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] * 2 + [(None, "http://a.org/x")], "page_id long, url string").selectExpr("*", "7 AS host", "7 AS rule", "7 AS verdict")
    got = Counter(tuple(r) for r in judge_urls(df, terms=terms, rules=rules, limit=limit).collect())
    want = Counter((i, *plain(u, terms, rules, limit)) for i, u in [*enumerate(URLS), *enumerate(URLS), (None, "http://a.org/x")])
    assert got == want


def test_empty_table_and_odd_terms(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(empty).count() == 0
    for bad in ("", "Free", "a\nb"):
        with pytest.raises(ValueError, match="terms"):
            judge_urls(empty, terms={bad: 1})


def test_longest_rule_wins_over_many():
    rules = Rules([(f"org/{'a' * n}", "allow") for n in range(50)] + [("x.org/a", "block")])
    assert rules.find("x.org", "/" + "a" * 60)[0] == "org/" + "a" * 49
    assert rules.find("x.org", "/ab")[0] == "x.org/a" and rules.find("y.org", "") is None
