"""Outlines of ink as a tree of curves, as sets of rows.

The sides of cells that ink does not share are directed, ink on their right, so each runs on into one next side: a successor table.
Rings get their names as components of sides and successors; area and box are sums over a ring.
What encloses a ring is found where a scan line leaves it: the curve met last to its left encloses it or lies beside it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, raster

#: A side's number is its start, row by row, then its direction: 0 right, 1 down, 2 left, 3 up. Rows and columns stay below 2^24.
BITS = 24
STEP_X, STEP_Y = (1, 0, -1, 0), (0, 1, 0, -1)


def _number(x: Column, y: Column, side: Column) -> Column:
    return F.shiftleft(y.cast("long"), BITS + 2) + F.shiftleft(x.cast("long"), 2) + side


def _step(values: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("side") + 1)


def sides(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, x, y, side, ex, ey: the directed sides of ink cells (keys, x, y; distinct) that no other ink cell shares, with start and end."""
    c = F.col
    around = F.array(*[F.struct(F.lit(k).alias("side"), F.lit(dx).alias("sx"), F.lit(dy).alias("sy")) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    out = cells.select(*keys, "x", "y", F.explode(around).alias("s")).select(*keys, (c("x") + c("s.sx")).alias("x"), (c("y") + c("s.sy")).alias("y"), c("s.side").alias("side"))
    out = out.withColumn("ex", c("x") + _step(STEP_X)).withColumn("ey", c("y") + _step(STEP_Y))
    # a shared side comes twice, in opposite directions
    once = out.groupBy(*keys, F.least("x", "ex").alias("lx"), F.least("y", "ey").alias("ly"), (c("side") % 2).alias("way")).agg(F.count("*").alias("n"), F.first(F.struct("x", "y", "side", "ex", "ey")).alias("s"))
    return once.where("n = 1").select(*keys, _number(c("s.x"), c("s.y"), c("s.side")).alias("id"), "s.*")


def rings(cells: DataFrame, keys: list[str], cut=None) -> DataFrame:
    """keys, id, next, curve_id, x, y, side, ex, ey: sides with their successor and the smallest side of their ring.

    Where ink cells touch at a corner only, the curve passes between the others: ink hangs together over corners.
    """
    if cut is None:
        from ..sources.storage import cut
    c = F.col
    edge = cut(sides(cells, keys))
    out = edge.groupBy(*keys, c("x").alias("ex"), c("y").alias("ey")).agg(F.collect_list("side").alias("ways"))  # one or two
    turn = F.array_min(F.transform("ways", lambda w: F.pmod(w - c("side") + 1, F.lit(4))))
    edge = edge.join(out, [*keys, "ex", "ey"]).withColumn("next", _number(c("ex"), c("ey"), F.pmod(c("side") + turn - 1, F.lit(4))))
    edge = cut(edge.select(*keys, "id", "next", "x", "y", "side", "ex", "ey"))
    ring = graph.components(edge.select(*keys, c("id").alias("a"), c("next").alias("b")), keys, cut)
    return edge.join(ring.select(*keys, c("node").alias("id"), c("component").alias("curve_id")), [*keys, "id"])


def curves(ring: DataFrame, keys: list[str], cut=None) -> DataFrame:
    """keys, curve_id, parent_id, area, length, x1, y1, x2, y2 of `rings`: area is positive for outlines of ink, negative for holes.

    A hole's parent is the outline around it, an outline's the hole that holds it, null outside all.
    """
    if cut is None:
        from ..sources.storage import cut
    c = F.col
    area = F.sum(c("x").cast("long") * c("ey") - c("ex").cast("long") * c("y"))
    own = ring.groupBy(*keys, "curve_id").agg(F.expr("count(*)").alias("length"), area.alias("twice"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    line = Window.partitionBy(*keys, "row").orderBy("x")  # a scan line of a page
    upright = ring.where("side % 2 = 1").select(*keys, "curve_id", F.least("y", "ey").alias("row"), "x")
    upright = upright.withColumn("left_curve", F.lag("curve_id").over(line))
    first = upright.groupBy(*keys, "curve_id").agg(F.min(F.struct("row", "x", "left_curve")).alias("f")).select(*keys, "curve_id", c("f.left_curve").alias("link"))
    own = cut(own.join(first, [*keys, "curve_id"]).select(*keys, "curve_id", "link", "twice", "length", "x1", "y1", "x2", "y2"))
    # a curve of the other kind at the left encloses this one, one of the same kind shares its parent
    kind = own.select(*keys, c("curve_id").alias("link"), (c("twice") > 0).alias("outline"))
    up = own.select(*keys, "curve_id", "link", (c("twice") > 0).alias("own")).join(kind, [*keys, "link"], "left")
    up = cut(up.select(*keys, "curve_id", "link", F.coalesce(c("own") != c("outline"), F.lit(True)).alias("found")))
    while up.where("not found").head(1):
        ahead = up.select(*keys, c("curve_id").alias("link"), c("link").alias("far"), c("found").alias("far_found"))
        moved = up.where("not found").join(ahead, [*keys, "link"]).select(*keys, "curve_id", c("far").alias("link"), c("far_found").alias("found"))
        up = cut(up.where("found").unionByName(moved))
    whole = own.drop("link").join(up.select(*keys, "curve_id", c("link").alias("parent_id")), [*keys, "curve_id"])
    return whole.select(*keys, "curve_id", "parent_id", (c("twice") / 2).alias("area"), "length", "x1", "y1", "x2", "y2")


def corners(points: list[tuple[int, int]], tolerance: float) -> list[tuple[int, int]]:
    """A closed polygon's corners: split at the point farthest from its first, each half simplified."""
    far = max(range(len(points)), key=lambda i: (math.dist(points[0], points[i]), -i))
    if far == 0:
        return points[:1]
    return raster.simplify(points[: far + 1], tolerance)[:-1] + raster.simplify([*points[far:], points[0]], tolerance)[:-1]


def polygon_sides(ring: DataFrame, keys: list[str], tolerance: float = 1.0) -> DataFrame:
    """keys, curve_id, k, x1, y1, x2, y2: the sides of each ring's simplified polygon in order, ink on their right.

    A ring is a group: its turns are walked from its smallest side on.
    """
    kinds = {f.name: f.dataType.simpleString() for f in ring.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "curve_id"]) + ", k int, x1 double, y1 double, x2 double, y2 double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        after = dict(zip(pdf["id"].tolist(), zip(pdf["next"].tolist(), pdf["x"].tolist(), pdf["y"].tolist(), pdf["side"].tolist(), strict=True), strict=True))
        at, last, points = key[-1], None, []
        for _ in range(len(after)):
            nxt, x, y, side = after[at]
            if side != last:
                points.append((x, y))
            at, last = nxt, side
        p = corners(points, tolerance)
        return pd.DataFrame([(*key, k, *map(float, (*a, *b))) for k, (a, b) in enumerate(zip(p, [*p[1:], p[0]], strict=True)) if a != b], columns=[*keys, "curve_id", "k", "x1", "y1", "x2", "y2"])

    return ring.groupBy(*keys, "curve_id").applyInPandas(run, schema)
