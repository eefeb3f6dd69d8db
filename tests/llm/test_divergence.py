import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkgraph.llm.divergence import share, source_divergence


def plain(rows, least=3, top=200):
    count, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= least]
        groups = {s: c for (x, s), c in count.items() if x == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered[:most], 1)]
    return sorted(out)


def got(df, **k):
    return sorted(tuple(r) for r in source_divergence(df, **k).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("size", [{}, {"block": 3, "chunk": 50, "stripe": 2, "top": 7}, {"block": 1, "chunk": 1 << 20, "stripe": 1, "least": 1}])
def test_tiles_equal_plain_sums(both, size):
    rows = [(r.lang, r.source, r.text) for r in both.collect()]
    assert got(both, **size) == plain(rows, size.get("least", 3), size.get("top", 200))


def test_groups_without_terms_ties_and_clashing_columns(spark, odd, clashing):
    rows = [("x", f"s{k}", "a b" if k < 3 else None) for k in range(7)] + [("y", "one", "1 2"), (None, None, ""), ("z", "only", "q q"), ("z", "only", "q"), ("z", "only", "q")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    want = plain(rows)
    assert got(df, block=2) == want and sum(r[0] == "x" and r[2] == "pair" for r in want) == 42
    assert source_divergence(odd.limit(0)).count() == 0
    assert got(clashing) == plain([(r.lang, r.source, r.text) for r in clashing.collect()])


def test_shares_are_exact_where_products_overflow():
    count, total = np.array([10**13 + 7, 0, 9 * 10**15 - 2]), 9 * 10**15 - 1
    assert share(count, total, 1).tolist() == [1 + 10**9 * (int(c) + 1) // (total + 1) for c in count]
