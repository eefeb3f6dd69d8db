"""Strokes from outlines: two facing sides of a curve, ink between them, are one bond of their distance's width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import along_line, cos_between, distance, offset_from_line
from . import spatial, stats

#: Where ink is looked for between two sides, as shares of the shorter one.
PROBES = tuple((k + 0.5) / 8 for k in range(8))


def facing(sides: DataFrame, reach: float, keys: list[str], least_cos: float = 0.95) -> DataFrame:
    """keys, short, long, gap: sides (keys, id, x1, y1, x2, y2, ink on their right) that run against each other, the middle of the shorter (of equally long
    ones the one with the larger id) beside the longer on its right, both its ends nearer than `reach` to the longer's line; gap is the larger distance.

    Sides meet through the middle of the shorter alone, by cell along the longer; their angle is compared after that.
    """
    c, keys = F.col, list(keys)
    middle = sides.select(*keys, "id", ((c("x1") + c("x2")) / 2).alias("x"), ((c("y1") + c("y2")) / 2).alias("y"))
    met = spatial.near_segments(middle, sides, reach, keys).where("id1 <> id2 and off < 0").select(*keys, c("id1").alias("short"), c("id2").alias("long"))
    at = lambda name, p: sides.select(*keys, c("id").alias(name), *[c(n).cast("double").alias(f"{p}_{n}") for n in ("x1", "y1", "x2", "y2")])
    both = met.join(at("short", "s"), [*keys, "short"]).join(at("long", "l"), [*keys, "long"])
    s, t = ([c(f"{p}_{n}") for n in ("x1", "y1", "x2", "y2")] for p in "sl")
    # to as many digits as all that is ranked: the last bits of equal lengths differ
    longer = F.struct(F.round(distance(*t), 6), -c("long")) > F.struct(F.round(distance(*s), 6), -c("short"))
    ends = [offset_from_line(*t, s[k], s[k + 1]) for k in (0, 2)]
    gap = F.greatest(F.abs(ends[0]), F.abs(ends[1]))
    return both.where(longer & (cos_between(*s, *t) < -least_cos)).withColumn("gap", F.round(gap, 6)).where(c("gap") < reach)


def inked(pairs: DataFrame, cells: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """The pairs of `facing` with ink (cells: keys, x, y) half way to the longer side at `share` of the probes along the shorter, or more."""
    c, keys = F.col, list(keys)
    s, t = ([c(f"{p}_{n}") for n in ("x1", "y1", "x2", "y2")] for p in "sl")
    x, y = s[0] + (s[2] - s[0]) * c("at"), s[1] + (s[3] - s[1]) * c("at")
    part = along_line(*t, c("px"), c("py")) / distance(*t)
    probe = pairs.select(*keys, "short", "long", *s, *t, F.explode(F.array(*[F.lit(p) for p in PROBES])).alias("at")).withColumn("px", x).withColumn("py", y).withColumn("part", part)
    probe = probe.select(*keys, "short", "long", *[F.floor(F.round((c(f"p{k}") + c(f"l_{k}1") + (c(f"l_{k}2") - c(f"l_{k}1")) * c("part")) / 2, 6)).cast("int").alias(k) for k in "xy"])
    hit = probe.join(cells.select(*keys, "x", "y"), [*keys, "x", "y"], "left_semi").groupBy(*keys, "short", "long").agg(F.count("*").alias("hits"))
    return pairs.join(hit.where(c("hits") >= share * len(PROBES)).drop("hits"), [*keys, "short", "long"], "left_semi")


def strokes(sides: DataFrame, cells: DataFrame, reach: float, keys: list[str]) -> DataFrame:
    """keys, id, x1, y1, x2, y2, width, members: the sides that others of their curve's stroke went to, moved to the middle of the ink.

    Each side goes to the nearest longer one it faces with ink between, then to the smallest id, so that what is left of a stroke is its longest
    side. The width is the gap of the longest side that came; the line reaches as far as either of the two does.
    """
    c, keys = F.col, list(keys)
    pairs = inked(facing(sides, reach, keys), cells, keys)
    s, t = ([c(f"{p}_{n}") for n in ("x1", "y1", "x2", "y2")] for p in "sl")
    ends = F.struct(F.round(-distance(*s), 6).alias("size"), c("gap"), "short", *[along_line(*t, s[k], s[k + 1]).alias(n) for k, n in ((2, "first"), (0, "last"))], *[v.alias(n) for v, n in zip(t, ("x1", "y1", "x2", "y2"), strict=True)])
    best = pairs.groupBy(*keys, "short").agg(F.min(F.struct("gap", "long", ends.alias("e"))).alias("b")).select(*keys, "short", "b.long", "b.e")
    root = best.join(best.select(*keys, c("short").alias("long")), [*keys, "long"], "left_anti").groupBy(*keys, c("long").alias("id")).agg(F.min("e").alias("e"), F.count("*").alias("members"))
    root = root.select(*keys, "id", "e.*", "members").withColumn("length", distance(c("x1"), c("y1"), c("x2"), c("y2")))
    ux, uy = (c("x2") - c("x1")) / c("length"), (c("y2") - c("y1")) / c("length")
    lo, hi, half = F.least(F.lit(0.0), "first"), F.greatest("length", "last"), c("gap") / 2
    line = {"x1": c("x1") + ux * lo - uy * half, "y1": c("y1") + uy * lo + ux * half, "x2": c("x1") + ux * hi - uy * half, "y2": c("y1") + uy * hi + ux * half}
    return root.select(*keys, "id", *[v.alias(n) for n, v in line.items()], c("gap").alias("width"), "members")


def thickness(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, thickness: the lower median width of a drawing's strokes."""
    return found.groupBy(*keys).agg(stats.lower_median("width").alias("thickness"))


def small_bonds(points: DataFrame, curves: DataFrame, keys: list[str], most_area: float, small: float, width: float) -> DataFrame:
    """keys, curve_id, x1, y1, x2, y2: curves of ink that are one small straight bond, between their extremes.

    curves: keys, curve_id, area; points: keys, curve_id, x, y, a curve's corners. A curve counts with an area over 0 and up to `most_area` and three corners or
    more, if its area is under `small` or no corner lies `width` or farther from the line between its extremes: those in the direction in
    which its box is larger, the smaller in the other direction of equal ones at either end.
    """
    c, keys = F.col, list(keys)
    few = curves.where((c("area") > 0) & (c("area") <= most_area)).select(*keys, "curve_id", "area")
    by_x, by_y = F.struct("x", "y"), F.struct(c("y"), c("x"))
    ends = points.join(few, [*keys, "curve_id"]).groupBy(*keys, "curve_id", "area").agg(
        F.count("*").alias("n"), (F.max("x") - F.min("x") > F.max("y") - F.min("y")).alias("wide"), F.min(by_x).alias("l"), F.max(F.struct("x", (-c("y")).alias("y"))).alias("r"), F.min(by_y).alias("t"), F.max(F.struct("y", (-c("x")).alias("x"))).alias("b")
    ).where("n > 2")
    line = ends.select(*keys, "curve_id", "area", *[F.when(c("wide"), a).otherwise(b).alias(n) for n, a, b in (("x1", c("l.x"), c("t.x")), ("y1", c("l.y"), c("t.y")), ("x2", c("r.x"), -c("b.x")), ("y2", -c("r.y"), c("b.y")))])
    off = F.abs(offset_from_line(c("x1"), c("y1"), c("x2"), c("y2"), c("x"), c("y")))
    far = points.join(line, [*keys, "curve_id"]).groupBy(*keys, "curve_id", "area", "x1", "y1", "x2", "y2").agg(F.max(off).alias("off"))
    return far.where((c("area") < small) | (c("off") < width)).select(*keys, "curve_id", "x1", "y1", "x2", "y2")
