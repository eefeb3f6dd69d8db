import math

import pytest
from pyspark.sql import functions as F

from inkgraph.functions import geometry as G
from inkgraph.functions import text as X
from inkgraph.operators import ensemble, evaluate, graph, labels, select, spatial, stats
from inkgraph.sources import dictionary


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_geometry(spark):
    v = lambda *x: [F.lit(float(a)) for a in x]
    r = one(
        spark, G.distance(*v(0, 0, 3, 4)), G.cos_between(*v(0, 0, 1, 0, 0, 0, 0, 1)), G.cos_between(*v(0, 0, 0, 0, 0, 0, 0, 1)), G.offset_from_line(*v(0, 0, 10, 0, 5, 3)),
        G.along_line(*v(0, 0, 10, 0, 5, 3)), G.beyond_line(*v(0, 0, 10, 0, 12, 3)), G.gap_between(tuple(v(0, 0, 10, 0)), tuple(v(0, 2, 10, 3))), G.gap_between(tuple(v(0, 0, 10, 0)), tuple(v(0, 2, 10, 7))),
        G.point_box_distance(*v(-3, -4, 0, 0, 5, 5)), G.point_box_distance(*v(1, 1, 0, 0, 5, 5)), G.box_box_distance(tuple(v(0, 0, 1, 1)), tuple(v(4, 5, 6, 6))), G.overlap_ratio(tuple(v(0, 0, 2, 2)), tuple(v(1, 0, 3, 2))),
        G.chebyshev(*v(0, 0, 3, -4)), G.area_ratio(F.lit(7), F.lit(2)), G.next_in_ring(F.lit(4), F.lit(5)),
    )
    assert list(r) == pytest.approx([5, 0, None, -3, 5, 2, 3, None, 5, 0, 5, 1 / 3, 4, 3, 0])
    x, y = G.rotate(*v(1, 0, 0, 0, math.pi / 2))
    assert list(one(spark, x, y)) == pytest.approx([0, 1], abs=1e-12)
    assert list(one(spark, *G.rotated_box(tuple(v(0, 0, 2, 1)), *v(10, 10, math.pi)))) == pytest.approx([8, 9, 10, 10])
    assert list(one(spark, *G.lengthened(*v(0, 0, 4, 0), F.lit(3)))) == pytest.approx([-2, 0, 6, 0])


def test_text(spark):
    r = one(spark, X.trim(F.lit(" \t\u000ba b\r\n")), X.readable_count(F.lit("CH3-q1")), X.array_text(F.array(F.lit(1), F.lit(2))), X.output_line(F.lit("C"), F.lit(None), F.lit("3")), X.box_text(*[F.lit(i) for i in range(4)]))
    assert list(r) == ["a b", 3, "[1, 2]", "C 3", "0x1-2x3"]


def test_dictionary(spark, tmp_path):
    p = tmp_path / "d.txt"
    p.write_text("# x y\n\nMe\tC\nOH  O \nlone\nON  1\nON 2\n b x\nN O\r\n")
    got = {r.key: r.value for r in dictionary.read_dictionary(spark, str(p)).collect()}
    assert got == {"Me": "C", "OH": "O", "ON": "2", "": "b x", "N": "O"}
    assert dictionary.find_dictionary("d.txt", folders=["/nowhere", str(tmp_path)]) == str(p)
    with pytest.raises(FileNotFoundError):
        dictionary.find_dictionary("d.txt", given="/nowhere/d.txt", folders=[str(tmp_path)])


def test_charges(spark):
    atoms = spark.createDataFrame([(0, "N+"), (1, "O-"), (2, "+"), (3, "S+"), (4, "H"), (5, "h"), (6, "Qx")], "atom_idx int, label string")
    bonds = spark.createDataFrame([(0, 1, 1, False), (2, 3, 1, True), (4, 0, 1, False), (4, 1, 1, False), (6, 99, 3, False)], "a int, b int, type int, hash boolean")
    spelling = spark.createDataFrame([("Qx", "Cl")], "key string, value string")
    got = {r.atom_idx: (r.label, r.charge) for r in labels.assign_charges(atoms, bonds, spelling, []).collect()}
    assert got == {0: ("N", 1), 1: ("O", -1), 2: ("", 0), 3: ("S", 0), 4: ("N", 0), 5: ("H", 0), 6: ("Cl", 0)}


def test_selection_ties(spark):
    rec = spark.createDataFrame([(1, 0, 72, 0.5), (1, 2, 300, 0.5), (1, 3, 300, 0.5), (2, 0, 72, -1.0), (2, 4, 500, -2.0), (3, 1, 150, 0.1)], "doc_id int, res_iter int, dpi int, confidence double")
    assert {r.doc_id: r.res_iter for r in select.best_resolution(rec).collect()} == {1: 2, 2: 0, 3: 1}
    assert select.best_record(rec.limit(0), [], "confidence", ["res_iter"]).count() == 0
    assert select.resolutions(spark).count() == 5 and select.resolutions(spark, 150).count() == 1
    assert one(spark, select.threshold(F.lit(0.0), F.lit(72)), select.threshold(F.lit(0.0), F.lit(150)), select.threshold(F.lit(0.3), F.lit(72))) == (0.2, 0.4, 0.3)
    r = one(spark, select.drawable(F.lit(6), F.lit(5), F.lit(2)), select.drawable(F.lit(5), F.lit(5), F.lit(2)), select.worth_keeping(F.lit(1), F.lit(6), F.lit(1)), select.within_half(F.lit(5.0), F.lit(0.0)))
    assert list(r) == [True, False, True, True]
    assert select.confident_bond_length(rec.withColumn("avg_bond", F.col("dpi").cast("double"))).first()[0] == 300.0


@pytest.mark.parametrize("n,want", [(1, 10.0), (2, 1.0), (4, 3.0), (6, 4.0)])
def test_percentile(spark, n, want):
    df = spark.range(1, n + 1).select(F.col("id").cast("double").alias("v"))
    assert df.agg(stats.percentile75("v")).first()[0] == want
    assert df.agg(stats.lower_median("v")).first()[0] == float((n - 1) // 2 + 1)


def test_histograms(spark):
    h = spark.createDataFrame([(i, n) for i, n in enumerate([0, 5, 0, 0, 0, 9, 1])], "bin int, n long")
    from inkgraph.operators import raster
    import numpy as np

    r = stats.otsu(h).first()
    assert (r.split, r.peak1, r.peak2, r.max1, r.max2) == raster.otsu_peaks(np.array([0, 5, 0, 0, 0, 9, 1])) == (1, 1, 5, 5, 9)
    g = spark.createDataFrame([(i, n) for i, n in enumerate([9, 1, 2, 3, 7, 3, 2, 4, 1])], "bin int, n long")
    assert stats.first_local_min(g).first()[0] == 6
    assert stats.first_local_min(h.limit(2)).first()[0] == 1
    runs = spark.createDataFrame([(1, 5), (2, 9), (3, 3), (4, 2), (5, 4)], "length int, n long")
    r = stats.noise_factors(runs).first()
    assert (r.thickness, r.factor, r.factor45) == (2, pytest.approx(5 / 9), 0.5)
    gaps = one(spark, stats.closest_gap(F.array(*[F.lit(x) for x in (3.0, 4.0, 5.0, 7.5, 8.2, 20.0)]), F.lit(30.0)), stats.closest_gap(F.array(F.lit(0.5)), F.lit(30.0)))
    assert list(gaps) == pytest.approx([9.501, 10.001])


def test_graph(spark):
    atoms = spark.createDataFrame([(i, float(i), 0.0, " ") for i in range(8)], "atom_idx int, x double, y double, label string")
    bonds = spark.createDataFrame([(0, 0, 1, 1, False), (1, 1, 0, 1, False), (2, 1, 2, 1, False), (3, 3, 3, 1, False), (4, 4, 5, 2, False), (5, 5, 6, 1, False), (6, 6, 99, 1, False)], "bond_idx int, a int, b int, type int, arom boolean")
    assert {r.bond_idx for r in graph.distinct_bonds(bonds, [], atoms).collect()} == {0, 2, 4, 5}
    assert {(r.a, r.b, r.type) for r in graph.merged_bonds(bonds, []).collect()} == {(0, 1, 2), (1, 2, 1), (4, 5, 2), (5, 6, 1), (6, 99, 1)}
    assert {r.atom_idx for r in graph.disconnected_atoms(atoms, bonds, []).collect()} == {7}
    assert {r.atom_idx for r in graph.connected_atoms(atoms, bonds, []).collect()} == set(range(7))
    assert {r.atom_idx for r in graph.terminal_atoms(bonds, []).collect()} == {2, 99}
    comp = {r.node: r.component for r in graph.components(bonds.where("a <> b")).collect()}
    assert comp == {0: 0, 1: 0, 2: 0, 4: 4, 5: 4, 6: 4, 99: 4}
    assert graph.components(bonds.limit(0)).count() == 0
    c = graph.counts(atoms, bonds, []).first()
    assert (c.n_atoms, c.n_bonds, c.max_type) == (8, 7, 2)
    lengths = graph.bond_lengths(atoms, bonds, [])
    assert lengths.where("bond_idx = 2").first().length == 1.0
    frag = graph.components(bonds.where("a <> b and b < 90")).withColumnRenamed("node", "atom_idx")
    pair = graph.rejoin_pairs(atoms, frag, [], 4.0).collect()
    assert [(r.a, r.b, r.gap, r.coincide) for r in pair] == [(2, 4, 2.0, False)]
    curves = spark.createDataFrame([(1, None, True), (2, 1, False), (3, None, False)], "curve_id int, parent_id int, drop boolean")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "curve_id int")
    assert {r[0] for r in graph.without_curves(rows, curves, []).collect()} == {2, 3}
    assert {r[0] for r in graph.without_curves(rows, curves, [], children=True).collect()} == {3}


def test_features(spark):
    atoms = spark.createDataFrame([(1, 0, "C", " ", 0), (1, 1, "O", "O", 0), (1, 2, "N", "N", 1), (1, 3, "C", "Et", 0), (1, 4, "Xx", "?", 0)], "m int, atom_idx int, symbol string, label string, charge int")
    bonds = spark.createDataFrame([(1, 0, 1, 2, False, False), (1, 0, 2, 1, True, False), (1, 0, 3, 1, False, True), (1, 3, 4, 1, False, False)], "m int, a int, b int, type int, hash boolean, wedge boolean")
    rings = spark.createDataFrame([(1, 0, 0, 1, 0, 0)], "m int, rings int, aromatic_rings int, fragments int, rings5 int, rings6 int")
    f = graph.features(atoms, bonds, ["m"], rings).first().features
    assert f == [1, 1, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0, 0, 1, 0, 0, 1, 1, 1, 1, 3, 5, 5, 4]
    assert one(spark, graph.linear_score(F.array(F.lit(1), F.lit(2)), [0.5, 2.0]))[0] == 4.5


def test_spatial_joins_equal_nested_loops(spark):
    import random

    rnd = random.Random(2)
    pts = [(i, rnd.uniform(-20, 20), rnd.uniform(-20, 20)) for i in range(120)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    got = {(r.id1, r.id2) for r in spatial.near_pairs(df, df, 3.0).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if max(abs(a[1] - b[1]), abs(a[2] - b[2])) < 3.0}
    boxes = [(i, x := rnd.randint(0, 300), y := rnd.randint(0, 300), x + rnd.randint(0, 90), y + rnd.randint(0, 90)) for i in range(80)]
    bdf = spark.createDataFrame(boxes, "id int, x1 int, y1 int, x2 int, y2 int")

    def iou(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        s = (a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2])
        return w * h / (s - w * h) if w > 0 and h > 0 else 0

    assert {(r.id1, r.id2) for r in spatial.overlapping(bdf, 0.2).collect()} == {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and iou(a, b) > 0.2}
    p2 = spark.createDataFrame([(i, rnd.randint(0, 300), rnd.randint(0, 300)) for i in range(50)], "id int, x int, y int")
    got = {(r.id, r.box) for r in spatial.inside_boxes(p2, bdf.withColumnRenamed("id", "box"), []).collect()}
    assert got == {(p.id, b[0]) for p in p2.collect() for b in boxes if b[1] <= p.x <= b[3] and b[2] <= p.y <= b[4]}


def test_ensemble(spark):
    assert ensemble.option_grid(spark).count() == 12
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (2, "", 3), (3, None, 4), (4, "", 5)], "ord int, key string, v int")
    assert {r.v for r in ensemble.unique_by_key(df, "key", ["ord"]).collect()} == {1, 3, 4, 5}
    lengths = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 1.0, 0.0), (1, 0, 2, 0.0, 0.0, 0.0, 1.0)], "bond_idx int, a int, b int, x1 double, y1 double, x2 double, y2 double")
    assert [(r.atom_idx, round(r.angle)) for r in ensemble.bond_angles(lengths, []).collect()] == [(0, 90)]
    ok = ensemble.plausible(F.lit(60.0), F.lit(120.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(7), F.lit(200.0), F.lit(0.5), F.lit(False), F.lit(False), F.lit(False))
    assert one(spark, ok, ensemble.plausible(*[F.lit(x) for x in (60.0, 160.0, 60.0, 1.0, 7, 200.0, 0.5, False, False, False)]))[0:2] == (True, False)


def test_training(spark):
    rows = [(f, r, f"k{f}{r}{j}", int(r == f % 5), [float(r == f % 5), float(r), 1.0]) for f in range(6) for r in range(5) for j in range(2)]
    df = spark.createDataFrame(rows, "file_id int, res_iter int, identity_key string, target int, features array<double>")
    w, recall = evaluate.train_weights(df, total=12, ideal=1.0, size=3, population=12, elite=3, rounds=6, seed=3)
    assert recall == pytest.approx(1.0) and abs(sum(w * w) - 1) < 1e-9
    truth = df.where("target = 1").select("file_id", "identity_key")
    assert tuple(evaluate.matched(df, truth, ["file_id"]).first()) == (12, 12)
    assert evaluate.ideal_recall(df, truth, ["file_id"]).first()[0] == 1.0


@pytest.mark.parametrize("take", [1, 7, 50, 100])
def test_first_rows(spark, take):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("v")).repartition(5)
    got = sorted(r.v for r in ensemble.first_rows(df, take, [F.col("v").desc()]).collect())
    assert got == sorted((i * 37 % 101 for i in range(100)), reverse=True)[:take][::-1]


def test_components_equal_union_find(spark):
    import random

    from inkgraph.operators import graph

    rnd = random.Random(7)
    edges = {(rnd.randrange(400), rnd.randrange(400) + 1000) for _ in range(330)} | {(i, i + 1) for i in range(5000, 5030)} | {(6000, 6000)}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(list(edges), "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(top)} and len(set(got.values())) > 20


@pytest.mark.parametrize("keys", [[], ["page"]])
def test_components_with_hubs_and_frequent_labels(spark, keys):
    # a star around 500, a chain that hangs on it, a pair; hubs and labels over 20 rows take the broadcast way
    edges = [(p, 500, 600 + k) for p in (1, 2) for k in range(80)] + [(p, 600 + k, 601 + k) for p in (1, 2) for k in range(79, 120)] + [(1, 3, 4), (2, 7, 500)]
    df = spark.createDataFrame(edges, "page int, a long, b long")
    plain, split = (sorted(map(tuple, graph.components(df, keys, hot_rows=n).select(*keys, "node", "component").collect())) for n in (10**6, 20))
    assert plain == split and len(plain) == (122 + 2 + 1 if not keys else 2 * 122 + 2 + 1)
    assert graph.frequent(df, ["a"], 20).collect() == [(500,)] and graph.frequent(df, ["a"], 10**6) is None
