"""Small set operators by hand: angles, reading order, curves with plain bonds, symbols among segments."""

import math

import pytest
from pyspark.sql import functions as F

from inkgraph.functions import geometry as G
from inkgraph.operators import graph, segment, select


def test_cosine_at_the_middle_point(spark):
    points = [(1, 0, 0, 0, 0, 1), (2, 2, 0, 0, 5, 5), (1, 0, 0, 0, -3, 0), (1, 0, 0, 0, 1, math.sqrt(3)), (0, 0, 0, 0, 1, 1)]
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "ax double, ay double, bx double, by double, cx double, cy double")
    got = [r.cos for r in df.select(G.cos_at(*map(F.col, df.columns)).alias("cos")).collect()]
    assert got[:4] == pytest.approx([0, 1, -1, 0.5]) and got[4] is None  # a point on the middle one makes no angle


def test_reading_order_is_total(spark):
    boxes = [(4, 0, 9, 5, 12), (3, 7, 2, 9, 4), (2, 1, 2, 3, 9), (1, 1, 2, 3, 4), (5, 1, 2, 3, 4)]
    df = spark.createDataFrame(boxes, "id int, x1 int, y1 int, x2 int, y2 int")
    assert [r.id for r in df.repartition(4).orderBy(*select.reading_order()).collect()] == [1, 5, 2, 3, 4]
    assert df.limit(0).orderBy(*select.reading_order()).count() == 0


def test_curves_with_a_plain_single_bond(spark):
    bonds = [(1, 0, 1, False, False), (1, 0, 1, False, False), (1, 1, 2, False, False), (1, 2, 1, True, False), (1, 3, 1, False, True), (2, 1, 1, False, False), (2, 1, 2, False, False), (2, None, 1, False, False)]
    df = spark.createDataFrame(bonds, "doc int, curve_id int, type int, wedge boolean, hash boolean")
    got = graph.plain_curves(df, ["doc"]).collect()
    assert len(got) == 3 and {tuple(r) for r in got} == {(1, 0), (2, 1), (2, None)}
    assert graph.plain_curves(df.where("type = 2"), ["doc"]).count() == 0


def test_symbols_among_segments(spark):
    """An arrow to the right, a plus of thick strokes, and on another page a disc, a dot, a frame and a diamond, which are neither."""
    shaft = [(x, y) for x in range(80) for y in (20, 21)]
    arrow = sorted({*shaft, *((60 + k, 20 + j) for k in range(20) for j in range(-(20 - k) // 3, (20 - k) // 3 + 1))})
    plus = sorted({*((x, y) for x in range(31) for y in (14, 15, 16)), *((x, y) for x in (14, 15, 16) for y in range(31))})
    disc = [(x, y) for x in range(21) for y in range(21) if (x - 10) ** 2 + (y - 10) ** 2 <= 100]
    frame = [(x, y) for x in range(30) for y in range(30) if min(x, y, 29 - x, 29 - y) < 2]
    diamond = [(x, y) for x in range(41) for y in range(41) if 18 <= abs(x - 20) + abs(y - 20) <= 20]
    rows = [(1, 1, 0, arrow), (1, 1, 1, plus), (1, 2, 0, disc), (1, 2, 1, [(3, 3)]), (1, 2, 2, frame), (1, 2, 3, diamond)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, segment_id int, points array<struct<x:int,y:int>>")
    got = {(r.page_no, r.segment_id): r for r in segment.find_symbols(df.withColumn("kind", F.lit("clash"))).collect()}
    assert {k: r.kind for k, r in got.items()} == {(1, 0): "arrow", (1, 1): "plus"}
    assert got[1, 0].head_x > 70 and got[1, 0].tail_x < 5
    assert (got[1, 1].head_x, got[1, 1].head_y) == (got[1, 1].tail_x, got[1, 1].tail_y) == (15, 15)
    assert segment.find_symbols(df.limit(0)).count() == 0
