import math

import pytest

from inkgraph.operators import tidy

K = ["drawing"]
ATOMS, BONDS = "drawing long, atom_idx int, x double, y double, label string", "drawing long, bond_idx int, a int, b int, type int, hash boolean, wedge boolean, arom boolean"


def made(spark, atoms, bonds, drawing=1, average=40.0):
    rows = [(drawing, k, float(a[0]), float(a[1]), a[2] if len(a) > 2 else " ") for k, a in enumerate(atoms)]
    links = [(drawing, k, b[0], b[1], b[2] if len(b) > 2 else 1, len(b) > 3 and "h" in b[3], len(b) > 3 and "w" in b[3], False) for k, b in enumerate(bonds)]
    return spark.createDataFrame(rows, ATOMS), spark.createDataFrame(links, BONDS), spark.createDataFrame([(drawing, average)], "drawing long, average double")


def pairs(bonds):
    return sorted((min(r.a, r.b), max(r.a, r.b), r.type) for r in bonds.collect())


def test_near_atoms_become_one_with_their_label(spark):
    atoms, bonds, _ = made(spark, [(0, 0), (2, 0, "N"), (4, 0), (40, 0), (80, 0)], [(0, 1), (2, 3), (3, 4), (1, 3)])
    a, b = tidy.near_united(atoms, bonds, 3.0, K)
    assert {(r.atom_idx, r.x, r.label) for r in a.collect()} == {(0, 2.0, "N"), (3, 40.0, " "), (4, 80.0, " ")} and pairs(b) == [(0, 3, 1), (3, 4, 1)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_lines_beside_each_other_add_up(spark, n):
    # n lines of one bond, and another bond of the drawing that lies far from them
    at = [(x, 5 * k) for k in range(n) for x in (0 if k == 0 else 3, 40 if k == 0 else 37)] + [(0, 60), (40, 60), (40, 0), (70, 20)]
    atoms, bonds, drawings = made(spark, at, [(2 * k, 2 * k + 1) for k in range(n)] + [(2 * n, 2 * n + 1), (2 * n + 2, 2 * n + 3)])
    got = tidy.parallel_merged(atoms, bonds, drawings, K)
    assert sorted(r.type for r in got.collect()) == [1, 1, n]
    assert {(r.a, r.b) for r in got.where(f"type = {n}").collect()} >= {(0, 1)}


def test_gap_begins_the_widest_break(spark):
    rows = [(1, k, 100 + k, g, 40.0) for k, g in enumerate((4.0, 5.0, 5.5, 16.0))] + [(2, 0, 1, 3.0, 40.0)]
    got = {r.drawing: r.reach for r in tidy.double_gaps(spark.createDataFrame(rows, "drawing long, short int, long int, gap double, average double"), K).collect()}
    assert got == {1: 5.5 + 2.5, 2: 3.0 + 2.5}


def test_bonds_are_parted_where_others_end(spark):
    atoms, bonds, _ = made(spark, [(0, 0), (90, 0), (30, 1), (30, 40), (60, -1), (60, -40), (2, 1), (2, 30)], [(0, 1, 2), (2, 3), (4, 5), (6, 7)])
    got = tidy.split_at_joints(atoms, bonds, 3.0, K)
    assert pairs(got) == [(0, 2, 2), (1, 4, 2), (2, 3, 1), (2, 4, 2), (4, 5, 1), (6, 7, 1)]  # 6 lies at an end, not inside
    assert sorted(r.bond_idx for r in got.collect()) == list(range(6))


def test_free_ends_meet_what_lies_ahead(spark):
    # 1 stops short of 2; 4 has a neighbour behind it only; a hash bond reaches farther
    at = [(0, 0), (35, 0), (41, 0), (80, 0), (80, 40), (78, 35), (120, 35), (0, 80), (30, 80), (46, 80), (90, 80)]
    atoms, bonds, drawings = made(spark, at, [(0, 1), (2, 3), (3, 4), (5, 6), (7, 8, 1, "h"), (9, 10)])
    a, b = tidy.ends_joined(atoms, bonds, drawings, 0.25, 0.45, K)
    assert pairs(b) == [(0, 1, 1), (1, 3, 1), (3, 4, 1), (5, 6, 1), (7, 8, 1), (8, 10, 1)]
    where = {r.atom_idx: (r.x, r.y) for r in a.collect()}
    assert where[1] == (38.0, 0.0) and where[8] == (38.0, 80.0) and 2 not in where and 9 not in where


def test_labels_name_the_ends_before_them(spark):
    atoms, bonds, drawings = made(spark, [(0, 0), (40, 0), (40, 40)], [(0, 1), (1, 2)])
    labels = spark.createDataFrame([(1, 0, "OH", -12.0, 1.0), (1, 1, "N", 42.0, 60.0), (1, 2, "Cl", 20.0, 3.0)], "drawing long, label_idx int, a string, x1 double, y1 double")
    got = {r.atom_idx: (r.x, r.y, r.label) for r in tidy.labels_attached(atoms, bonds, drawings, labels, 0.8, K).collect()}
    assert got == {0: (-12.0, 1.0, "OH"), 1: (40.0, 0.0, " "), 2: (42.0, 60.0, "N")}


def test_growing_lines_are_wedges(spark):
    atoms, bonds, drawings = made(spark, [(0, 0), (40, 0), (80, 0), (80, 50)], [(0, 1), (2, 1), (2, 3, 2)])
    rows = [(1, k, 2.0 + 4 * k, 0.3, 2 + k) for k in range(10)] + [(1, 20 + k, 42.0 + 4 * k, 0.0, 3.0 + (k % 2)) for k in range(10)] + [(1, 40 + k, 80.0, 2.0 + 5 * k, 2.0 + k) for k in range(10)]
    samples = spark.createDataFrame([(d, i, float(x), float(y), float(w)) for d, i, x, y, w in rows], "drawing long, id int, x double, y double, w double")
    got = {r.bond_idx: (r.a, r.b, r.wedge) for r in tidy.wedges(atoms, bonds, drawings, samples, K).collect()}
    assert got == {0: (0, 1, True), 1: (2, 1, False), 2: (2, 3, False)}
    narrow = samples.withColumn("w", tidy.F.lit(12.0) - tidy.F.col("w"))
    assert {r.bond_idx: (r.a, r.b) for r in tidy.wedges(atoms, bonds, drawings, narrow, K).where("wedge").collect()} == {0: (1, 0)}


def test_forks_of_wedges_go(spark):
    atoms, bonds, drawings = made(spark, [(0, 0), (40, 0), (43, 4), (43, -4), (-30, 20), (-3, -4)], [(0, 1, 1, "w"), (1, 2), (1, 3), (0, 4), (0, 5)])
    assert pairs(tidy.forks_trimmed(atoms, bonds, drawings, 0.25, K)) == [(0, 1, 1), (0, 4, 1), (0, 5, 1)]


def test_circles_mark_the_ring_around_them(spark):
    pts = [(100 + 40 * math.cos(k * math.pi / 3), 100 + 40 * math.sin(k * math.pi / 3)) for k in range(6)] + [(180, 100)]
    atoms, bonds, drawings = made(spark, pts, [*((k, (k + 1) % 6) for k in range(6)), (0, 6)])
    circles = spark.createDataFrame([(1, 100.0, 100.0, 44.0)], "drawing long, x double, y double, diameter double")
    assert {r.bond_idx: r.arom for r in tidy.round_rings(atoms, bonds, drawings, circles, K).collect()} == {**{k: True for k in range(6)}, 6: False}


def test_drawings_do_not_mix(spark):
    one, two = made(spark, [(0, 0), (2, 0), (40, 0)], [(0, 1), (1, 2)]), made(spark, [(1, 0), (41, 0)], [(0, 1)], drawing=2)
    a, b = tidy.near_united(one[0].union(two[0]), one[1].union(two[1]), 3.0, K)
    assert sorted((r.drawing, r.atom_idx) for r in a.collect()) == [(1, 0), (1, 2), (2, 0), (2, 1)] and b.count() == 2
    assert tidy.near_united(one[0].limit(0), one[1].limit(0), 3.0, K)[1].count() == 0
