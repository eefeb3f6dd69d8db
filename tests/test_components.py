import random

import pytest

from inkgraph.operators import graph, outline


def plain(rows):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, a, b in rows:
        x, y = find((k, a)), find((k, b))
        root[max(x, y)] = min(x, y)
    return sorted((*n, find(n)[1]) for n in root)


@pytest.mark.parametrize("small", [1 << 16, 40, 0])
def test_graphs_on_either_side_of_the_bound(spark, small):
    """Small graphs take no rounds; those above the bound do, with the same result."""
    rng = random.Random(3)
    rows = [(k, rng.randrange(30), rng.randrange(30)) for k in range(60) for _ in range(rng.randint(1, 20))]
    rows += [(99, k, k + 1) for k in range(100)] + [(98, 7, 7), (98, -3, 2**40)]
    cuts = []

    def cut(df):
        cuts.append(df)
        return df.localCheckpoint()

    got = graph.components(spark.createDataFrame(rows, "k int, a long, b long"), ["k"], cut, small=small)
    assert got.columns == ["k", "node", "component"]
    assert sorted(map(tuple, got.collect())) == plain(rows)
    assert (len(cuts) <= 3) == (small > 100)


def test_named_graphs_nulls_and_none(spark):
    rows = [("x", 1, "b", "a"), ("x", 1, "ab", "b"), ("x", 2, "b", "c"), ("x", 1, "z", None), (None, 1, "b", "c"), ("y", 1, None, None)]
    df = spark.createDataFrame(rows, "p string, q int, a string, b string")
    got = sorted(map(tuple, graph.components(df, ["p", "q"]).collect()))
    assert got == [("x", 1, "a", "a"), ("x", 1, "ab", "a"), ("x", 1, "b", "a"), ("x", 1, "z", "z"), ("x", 2, "b", "b"), ("x", 2, "c", "b")]
    assert graph.components(df.limit(0), ["p", "q"]).count() == 0


def test_rings_take_no_rounds(spark):
    cells = spark.createDataFrame([(0, x, y) for x in range(40) for y in range(3)], "page int, x int, y int")
    cuts = []

    def cut(df):
        cuts.append(df)
        return df.localCheckpoint()

    ring = outline.rings(cells, ["page"], cut)
    assert ring.select("curve_id").distinct().count() == 1 and ring.count() == 86
    assert len(cuts) <= 4


@pytest.mark.parametrize("held", [1 << 20, 300])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_edges_that_connect_nothing_new_go_before_the_rounds(spark, keys, held):
    rng = random.Random(5)
    rows = [(k, 100 * k + a, 100 * k + 50 + b) for k in range(5) for a in range(30) for b in range(30)] + [(7, 990, 990), (7, 995, None)]
    rng.shuffle(rows)
    cuts = []

    def cut(df):
        cuts.append(df.localCheckpoint())
        return cuts[-1]

    got = graph.components(spark.createDataFrame(rows, "k int, a long, b long").repartition(4), keys, cut, small=0, held=held)
    want = [(*([k] if keys else []), n, c) for k, n, c in plain([(k, a, a if b is None else b) for k, a, b in rows])]
    assert sorted(map(tuple, got.collect())) == want
    assert max(df.count() for df in cuts[3 if keys else 0 :]) < (len(rows) if held == 300 else len(rows) // 2)


def test_small_graphs_are_not_counted_one_by_one(spark):
    rows = [(k, k % 7, k % 5) for k in range(2000)]
    cuts = []

    def cut(df):
        cuts.append(df.localCheckpoint())
        return cuts[-1]

    got = graph.components(spark.createDataFrame(rows, "k int, a long, b long"), ["k"], cut, small=100)
    assert sorted(map(tuple, got.collect())) == plain(rows)
    assert ["k"] not in [df.columns for df in cuts] and len(cuts) == 3


def test_fragments_take_lines_as_they_are(spark, monkeypatch):
    from inkgraph.plans import catalog

    sf = "/root/testdata/sf0.001"
    once = graph.components(catalog.order_bonds(spark, sf), ["l_orderkey"])
    want = once.groupBy("l_orderkey", "component").count().count()
    monkeypatch.setattr(graph, "distinct_rows", None)
    assert catalog.fragment_bbox(spark, sf).count() == want
