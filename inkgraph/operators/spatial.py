"""Spatial joins. Predicates on distances plan as nested loops; here points and boxes are dealt to grid cells, and joined by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import along_line, chebyshev, distance, offset_from_line, overlap_ratio


def _cell(c: Column, side: float) -> Column:
    return F.floor(c / side).cast("long")


def near_pairs(left: DataFrame, right: DataFrame, reach: float, metric=chebyshev, keys: list[str] = (), ordered: bool = False) -> DataFrame:
    """Pairs of left (keys, id, x, y) and right (the same) closer than `reach`: keys, id1, id2, d.

    With `ordered` only pairs of id1 < id2. Cells have the side `reach`; left is dealt to its own cell and right to the nine around its own.
    """
    keys = list(keys)
    a = left.select(*keys, F.col("id").alias("id1"), F.col("x").alias("x1"), F.col("y").alias("y1"), _cell(F.col("x"), reach).alias("cx"), _cell(F.col("y"), reach).alias("cy"))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    b = right.select(*keys, F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(around).alias("i")).withColumn("j", F.explode(around))
    b = b.select(*keys, "id2", "x2", "y2", (_cell(F.col("x2"), reach) + F.col("i")).alias("cx"), (_cell(F.col("y2"), reach) + F.col("j")).alias("cy"))
    d = metric(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    met = a.join(b, [*keys, "cx", "cy"])
    met = met.where("id1 < id2") if ordered else met
    return met.withColumn("d", d).where(F.col("d") < reach).select(*keys, "id1", "id2", "d")


def nearest(left: DataFrame, right: DataFrame, reach: float, metric, keys: list[str] = ()) -> DataFrame:
    """For each left the nearest right within reach: keys, id1, id2, d; ties go to the smallest id2."""
    best = F.min(F.struct("d", "id2")).alias("best")
    return near_pairs(left, right, reach, metric, keys).groupBy(*keys, "id1").agg(best).select(*keys, "id1", "best.id2", "best.d")


def overlapping(boxes: DataFrame, least: float, keys: list[str] = (), side: float = 64.0, differ: float | None = None) -> DataFrame:
    """Pairs id1 < id2 of boxes (keys, id, x1, y1, x2, y2) with an intersection over union above `least`: keys, id1, id2, iou.

    With `differ`, widths and heights must also differ by less than that share of the smaller. Boxes are dealt to the cells
    they cover; a pair is made in the cell of its intersection's first corner only. Boxes without area pair with none.
    """
    keys = list(keys)
    b = boxes.where("x2 > x1 and y2 > y1")
    span = lambda lo, hi: F.sequence(_cell(F.col(lo), side), _cell(F.col(hi), side))
    b = b.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    names = ["id", "x1", "y1", "x2", "y2"]
    one, two = (b.select(*keys, "cx", "cy", *[F.col(n).alias(f"{p}_{n}") for n in names]) for p in "ab")
    a_, b_ = (tuple(F.col(f"{p}_{n}") for n in names[1:]) for p in "ab")
    met = one.join(two, [*keys, "cx", "cy"]).where("a_id < b_id")
    met = met.where((F.col("cx") == _cell(F.greatest(a_[0], b_[0]), side)) & (F.col("cy") == _cell(F.greatest(a_[1], b_[1]), side)))
    met = met.withColumn("iou", overlap_ratio(a_, b_)).where(F.col("iou") > least)
    if differ is not None:
        for k in (0, 1):
            w1, w2 = a_[k + 2] - a_[k], b_[k + 2] - b_[k]
            met = met.where(F.abs(w1 - w2) < differ * F.least(w1, w2))
    return met.select(*keys, F.col("a_id").alias("id1"), F.col("b_id").alias("id2"), "iou")


def inside_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], side: float = 32.0) -> DataFrame:
    """keys, id, box: which points (keys, id, x, y) lie in which boxes (keys, box, x1, y1, x2, y2), borders included."""
    span = lambda lo, hi: F.sequence(_cell(F.col(lo), side), _cell(F.col(hi), side))
    b = boxes.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    p = points.withColumn("cx", _cell(F.col("x"), side)).withColumn("cy", _cell(F.col("y"), side))
    return p.join(b, [*keys, "cx", "cy"]).where("x between x1 and x2 and y between y1 and y2").select(*keys, "id", "box")


#: Points of a graph up to which its segments meet each of them, in place of the cells they run through.
FEW_POINTS = 32


def near_segments(points: DataFrame, segments: DataFrame, reach: float, keys: list[str] = (), more: list[str] = (), few: int = FEW_POINTS) -> DataFrame:
    """keys, id1, id2, along, off: points (keys, id, x, y) beside segments (keys, id, x1, y1, x2, y2) and nearer than `reach` to their line.

    `along` is where a point projects, from 0 to the segment's length, both included; `off` its signed distance as of `geometry.offset_from_line`. A segment
    whose keys have up to `few` points meets all of them. Others are dealt to the cells around places spaced by `reach` along them, so to a number of
    cells in proportion to their length, each once. A segment without length meets none. `more` names columns of segments that are passed on.
    """
    # a point beside the line is within hypot(1, 1/2) reaches of a place; so far around a place there are the cells of four corners
    keys, wide, side, c = list(keys), 1.12 * reach, 2.25 * reach, F.col
    cell = lambda x, y: F.shiftleft(_cell(x, side), 32) + _cell(y, side)
    s = segments.select(*keys, c("id").alias("id2"), *[c(n).cast("double").alias(n) for n in ("x1", "y1", "x2", "y2")], *more).withColumn("size", distance(c("x1"), c("y1"), c("x2"), c("y2"))).where("size > 0")
    p = points.select(*keys, c("id").alias("id1"), c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))

    own = [*keys, "id2", "x1", "y1", "x2", "y2", *more, "size"]
    line = (c("x1"), c("y1"), c("x2"), c("y2"), c("x"), c("y"))

    def beside(met: DataFrame) -> DataFrame:
        met = met.withColumn("along", along_line(*line)).withColumn("off", offset_from_line(*line))
        return met.where((c("along") >= 0) & (c("along") <= c("size")) & (F.abs("off") < reach)).select(*keys, "id1", "id2", "along", "off", *more)

    if keys:
        p = p.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
        crowded = p.where(c("_n") > few).select(*keys).distinct()
        close = beside(s.join(p.where(c("_n") <= few), keys))
        p, s = p.where(c("_n") > few), s.join(crowded, keys, "left_semi")
    s = s.select(*own, F.explode(F.sequence(F.lit(0), F.ceil(c("size") / reach).cast("int"))).alias("k"))
    # along a line a cell is entered once, so what the place before did not have is new; the first has none before. Steps are columns, so each is computed once
    s = s.select(*own, (F.least(c("k") * reach, c("size")) / c("size")).alias("now"), F.when(c("k") > 0, (c("k") - 1) * reach / c("size")).alias("old"))
    s = s.select(*own, *[(c(f"{n}1") + (c(f"{n}2") - c(f"{n}1")) * c(t)).alias(f"{t}_{n}") for t in ("now", "old") for n in "xy"])
    s = s.select(*own, *[_cell(c(f"{t}_{n}") + i * wide, side).alias(f"{t}_{n}{i + 1}") for t in ("now", "old") for n in "xy" for i in (-1, 1)])
    four = lambda t: F.array(*[F.shiftleft(f"{t}_x{i}", 32) + c(f"{t}_y{j}") for i in (0, 2) for j in (0, 2)])
    s = s.select(*own, F.explode(F.array_except(four("now"), four("old"))).alias("cell"))
    far = beside(p.withColumn("cell", cell(c("x"), c("y"))).join(s, [*keys, "cell"]))
    return close.unionByName(far) if keys else far


def near_boxes(boxes: DataFrame, reach: float, keys: list[str] = (), side: float | None = None) -> DataFrame:
    """keys, id1, id2: pairs id1 < id2 of boxes (keys, id, x1, y1, x2, y2) whose gap is under `reach` in both directions.

    Boxes grow by `reach` to the right and downwards and are dealt to the cells they then cover; a pair is made in the cell of the first corner of the grown
    boxes' intersection only.
    """
    keys, side = list(keys), side or max(4.0 * reach, 32.0)
    names = ["id", "x1", "y1", "x2", "y2"]
    span = lambda lo, hi: F.sequence(_cell(F.col(lo), side), _cell(F.col(hi) + reach, side))
    b = boxes.select(*keys, *names).withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    one, two = (b.select(*keys, "cx", "cy", *[F.col(n).alias(f"{p}_{n}") for n in names]) for p in "ab")
    met = one.join(two, [*keys, "cx", "cy"]).where("a_id < b_id")
    for k, cell in (("x", "cx"), ("y", "cy")):
        first = F.greatest(f"a_{k}1", f"b_{k}1")
        met = met.where((first < F.least(f"a_{k}2", f"b_{k}2") + reach) & (F.col(cell) == _cell(first, side)))
    return met.select(*keys, F.col("a_id").alias("id1"), F.col("b_id").alias("id2"))
