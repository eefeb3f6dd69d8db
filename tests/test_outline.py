import itertools
import math
import random

import numpy as np
import pytest

from inkgraph.operators import graph, outline, strokes


def cells_of(spark, masks):
    rows = [(k, int(x), int(y)) for k, m in enumerate(masks) for y, x in np.argwhere(m)]
    return spark.createDataFrame(rows, "page int, x int, y int")


def flood(mask, diagonal):
    """Parts of a mask as sets of (y, x)."""
    free, out = {(int(y), int(x)) for y, x in np.argwhere(mask)}, []
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    while free:
        part, todo = set(), [free.pop()]
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            for a, b in steps:
                if (y + a, x + b) in free:
                    free.remove((y + a, x + b))
                    todo.append((y + a, x + b))
        out.append(part)
    return out


def tree(mask):
    """(kind, first cell, area, first cell of the parent) of each outline and hole: ink hangs together over corners, ground does not."""
    ink = flood(mask, True)
    ground = flood(~np.pad(mask, 1), False)
    ground = [{(y - 1, x - 1) for y, x in g} for g in ground]
    page = next(g for g in ground if (-1, -1) in g)
    out = []
    for part in ink:
        around = next(g for g in ground if (min(part)[0], min(part)[1] - 1) in g)
        holes = [g for g in ground if g is not page and any((y + a, x + b) in part for y, x in g for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
        inner = [g for g in holes if g is not around]
        out += [("hole", min(g), sum(len(q) for q in [g]), min(part)) for g in inner]
        out.append(("ink", min(part), None, None if around is page else min(around)))
    return out


def got_tree(df):
    rows = df.collect()
    first = {(r.page, r.curve_id): ((r.curve_id >> 26), (r.curve_id >> 2) & ((1 << 24) - 1)) for r in rows}
    kind = {(r.page, r.curve_id): r.area > 0 for r in rows}
    assert all(r.parent_id is None or kind[r.page, r.parent_id] != kind[r.page, r.curve_id] for r in rows)
    return sorted((r.page, "ink" if r.area > 0 else "hole", first[r.page, r.curve_id], repr(first.get((r.page, r.parent_id)))) for r in rows)


def test_tree_of_random_pages(spark):
    rng = np.random.default_rng(3)
    masks = [rng.random((14, 17)) < p for p in (0.05, 0.35, 0.5, 0.65, 0.9)]
    frame = np.zeros((15, 15), bool)
    for k in (0, 2, 4):
        frame[k : 15 - k, k : 15 - k] = True
        frame[k + 1 : 14 - k, k + 1 : 14 - k] = False
    masks += [frame, np.ones((3, 4), bool), np.eye(6, dtype=bool)]
    ring = outline.rings(cells_of(spark, masks), ["page"])
    df = outline.curves(ring, ["page"])
    want = sorted((k, kind, first, repr(parent)) for k, m in enumerate(masks) for kind, first, _, parent in tree(m))
    assert got_tree(df) == want
    rows = df.collect()
    for k, m in enumerate(masks):
        assert sum(r.area for r in rows if r.page == k) == m.sum()  # outlines less holes
        assert sum(r.length for r in rows if r.page == k) == sum((np.diff(np.pad(m, 1).astype(int), axis=a) != 0).sum() for a in (0, 1))
    nested = {r.curve_id: r for r in rows if r.page == 5}
    depth = lambda r: 0 if r.parent_id is None else 1 + depth(nested[r.parent_id])
    assert sorted(depth(r) for r in nested.values()) == [0, 1, 2, 3, 4, 5]
    assert outline.curves(outline.rings(cells_of(spark, masks).limit(0), ["page"]), ["page"]).count() == 0


def test_deleting_a_curve_takes_its_holes(spark):
    m = np.zeros((9, 20), bool)
    m[1:8, 1:8] = True
    m[3:5, 3:5] = False
    m[2:4, 12:15] = True
    ring = outline.rings(cells_of(spark, [m]), ["page"])
    tree_ = outline.curves(ring, ["page"]).withColumn("drop", outline.F.col("area") > 20)
    left = graph.without_curves(ring, tree_, ["page"], children=True).select("curve_id").distinct().collect()
    assert len(left) == 1 and left[0].curve_id >> 26 == 2


def line_mask(shape, a, b, width):
    ys, xs = np.mgrid[: shape[0], : shape[1]]
    px, py = xs + 0.5, ys + 0.5
    size = math.dist(a, b)
    t = ((b[0] - a[0]) * (px - a[0]) + (b[1] - a[1]) * (py - a[1])) / size
    off = ((b[1] - a[1]) * (px - a[0]) - (b[0] - a[0]) * (py - a[1])) / size
    return (t >= 0) & (t <= size) & (abs(off) <= width / 2)


def test_edges_of_a_thick_stroke_become_one_bond(spark):
    shape = (90, 120)
    two = line_mask(shape, (10, 20), (110, 20), 4) | line_mask(shape, (10, 32), (110, 32), 4)  # a double bond: ground between
    masks = [line_mask(shape, (10, 45), (110, 45), 6), line_mask(shape, (15, 10), (100, 75), 7), two]
    cells = cells_of(spark, masks)
    sides = outline.polygon_sides(outline.rings(cells, ["page"]), ["page"], 1.5)
    sides = sides.selectExpr("page", "curve_id * 1000 + k AS id", "x1", "y1", "x2", "y2")
    found = strokes.strokes(sides, cells, 12.0, ["page"]).collect()
    long = {k: [r for r in found if r.page == k and math.dist((r.x1, r.y1), (r.x2, r.y2)) > 50] for k in range(3)}
    assert [len(long[k]) for k in range(3)] == [1, 1, 2]
    ends = lambda r: sorted([(r.x1, r.y1), (r.x2, r.y2)])
    for k, want in ((0, [(10, 45), (110, 45)]), (1, [(15, 10), (100, 75)])):
        assert all(math.dist(p, q) < 4 for p, q in zip(ends(long[k][0]), want, strict=True))
    assert abs(long[0][0].width - 6) < 1 and abs(long[1][0].width - 7) < 1.5 and all(abs(r.width - 4) < 1 for r in long[2])
    width = {r.page: r.thickness for r in strokes.thickness(strokes.strokes(sides, cells, 12.0, ["page"]), ["page"]).collect()}
    assert abs(width[2] - 4) < 1


def plain_facing(sides, reach):
    out = []
    for i, j in itertools.permutations(range(len(sides)), 2):
        s, t = sides[i], sides[j]
        ls, lt = math.dist(s[:2], s[2:]), math.dist(t[:2], t[2:])
        if not ls or not lt or (lt, -j) < (ls, -i):
            continue
        off = lambda x, y, t=t, lt=lt: ((t[3] - t[1]) * (x - t[0]) - (t[2] - t[0]) * (y - t[1])) / lt
        mx, my = (s[0] + s[2]) / 2, (s[1] + s[3]) / 2
        along = ((t[2] - t[0]) * (mx - t[0]) + (t[3] - t[1]) * (my - t[1])) / lt
        cos = ((s[2] - s[0]) * (t[2] - t[0]) + (s[3] - s[1]) * (t[3] - t[1])) / ls / lt
        gap = max(abs(off(*s[:2])), abs(off(*s[2:])))
        if 0 <= along <= lt and -reach < off(mx, my) < 0 and cos < -0.95 and gap < reach:
            out.append((i, j, round(gap, 6)))
    return sorted(out)


def test_facing_sides_equal_brute_force(spark):
    rng = random.Random(5)
    sides = []
    for _ in range(150):
        x, y, turn, size = rng.uniform(0, 80), rng.uniform(0, 80), rng.choice([0, math.pi, 0.1, math.pi + 0.05, 1.0, 1.0 + math.pi]), rng.uniform(1, 40)
        sides.append((x, y, x + size * math.cos(turn), y + size * math.sin(turn)))
    sides.append((5.0, 5.0, 5.0, 5.0))
    df = spark.createDataFrame([(1, i, *s) for i, s in enumerate(sides)], "page int, id int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.short, r.long, round(r.gap, 6)) for r in strokes.facing(df, 9.0, ["page"]).collect())
    want = plain_facing(sides, 9.0)
    assert got == want and len(want) > 20


@pytest.mark.parametrize("seed", [1, 2])
def test_small_bonds_equal_plain_ones(spark, seed):
    rng = random.Random(seed)
    curves, points = [], []
    for k in range(60):
        n, area = rng.randint(1, 7), rng.choice([-5.0, 3.0, 12.0, 30.0, 200.0])
        flat = rng.random() < 0.5
        curves.append((1, k, area))
        points += [(1, k, float(x0), float(rng.randint(0, 2) if flat else rng.randint(0, 20))) for x0 in (rng.randint(0, 20) for _ in range(n))]
    got = strokes.small_bonds(spark.createDataFrame(points, "page int, curve_id int, x double, y double"), spark.createDataFrame(curves, "page int, curve_id int, area double"), ["page"], 100.0, 5.0, 3.0)
    want = []
    for _, k, area in curves:
        p = [(x, y) for _, c, x, y in points if c == k]
        if not 0 < area <= 100 or len(p) < 3:
            continue
        xs, ys = [q[0] for q in p], [q[1] for q in p]
        a, b = (min(p), max(p, key=lambda q: (q[0], -q[1]))) if max(xs) - min(xs) > max(ys) - min(ys) else (min(p, key=lambda q: (q[1], q[0])), max(p, key=lambda q: (q[1], -q[0])))
        size = math.dist(a, b)
        off = max(abs((b[1] - a[1]) * (x - a[0]) - (b[0] - a[0]) * (y - a[1])) / size for x, y in p) if size else None
        if area < 5 or off is not None and off < 3:
            want.append((k, *a, *b))
    assert sorted((r.curve_id, r.x1, r.y1, r.x2, r.y2) for r in got.collect()) == sorted(want) and len(want) > 5
