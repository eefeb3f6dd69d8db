"""Page segmentation: segments of connected ink, their clusters, and the boxes that hold drawings.

Pixels are labelled by a kernel, a page at a time. All after that is sets of rows: segments carry points and margins, and
their measures are columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from . import graph, raster, spatial, stats

MOST_SEGMENTS, MAX_DIST, MAX_RATIO, SINGLE_DIST = 10000, 50, 50, 1000
POINT = "array<struct<x:int,y:int>>"
SEGMENTS = f"doc_id long, page_no int, segment_id int, points {POINT}, margin {POINT}, skipped boolean"


def page_segments(gray: np.ndarray, threshold: float = 0.1, adaptive: bool = False, most: int | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
    """((points, margin) of each segment, skipped); points as rows (x, y), in reading order.

    The margin is every second pixel with a background pixel at a corner. Specks go: of at most 2 pixels, or of a share of the page
    if it is adaptive. Over `most` (MOST_SEGMENTS) the page is skipped and gives none.
    """
    mask = raster.ink(gray, threshold)
    lab = raster.components(mask)
    p = np.pad(mask, 1)
    inner = p[:-2, :-2] & p[:-2, 2:] & p[2:, :-2] & p[2:, 2:]
    speck = max(2, (min(gray.shape) // 200) ** 2) if adaptive else 2
    ys, xs = np.nonzero(lab)
    order = np.argsort(lab[ys, xs], kind="stable")
    ys, xs = ys[order], xs[order]
    edges = np.flatnonzero(np.diff(lab[ys, xs])) + 1
    out = []
    for y, x in zip(np.split(ys, edges), np.split(xs, edges), strict=True):
        if len(y) > speck:
            pts = np.stack([x, y], axis=1)
            out.append((pts, pts[~inner[y, x]][::2]))
    return ([], True) if len(out) > (MOST_SEGMENTS if most is None else most) else (out, False)


def find_segments(pages: DataFrame, threshold: float = 0.1) -> DataFrame:
    """SEGMENTS of pages (doc_id, page_no, width, height, gray binary, adaptive). A skipped page has one row without points."""
    most = MOST_SEGMENTS

    def run(batches):
        for pdf in batches:
            rows = []
            for p in pdf.itertuples():
                gray = np.frombuffer(p.gray, np.uint8).reshape(p.height, p.width)
                found, skipped = page_segments(gray, threshold, bool(p.adaptive), most)
                as_rows = lambda a: [{"x": int(x), "y": int(y)} for x, y in a]
                rows += [(p.doc_id, p.page_no, k, as_rows(pts), as_rows(m), False) for k, (pts, m) in enumerate(found)]
                if skipped:
                    rows.append((p.doc_id, p.page_no, -1, [], [], True))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "segment_id", "points", "margin", "skipped"])

    return pages.select("doc_id", "page_no", "width", "height", "gray", "adaptive").mapInPandas(run, SEGMENTS)


def measured(segments: DataFrame) -> DataFrame:
    """segments with x1, y1, x2, y2, area (points), aspect, fill. A segment of one column has aspect 0."""
    least, most = (lambda c, f=f: f(F.transform("points", lambda p: p[c])) for f in (F.array_min, F.array_max))
    out = segments.where(F.size("points") > 0)
    out = out.withColumns({"x1": least("x"), "y1": least("y"), "x2": most("x"), "y2": most("y"), "area": F.size("points")})
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    aspect = F.when(w == 0, 0.0).otherwise(F.coalesce(F.try_divide(h.cast("double"), w), F.lit(0.0)))
    return out.withColumn("aspect", aspect).withColumn("fill", F.col("area") / ((w + 1) * (h + 1)).cast("double"))


def without_separators(m: DataFrame, area: int = 300, aspect: float = 100.0) -> DataFrame:
    """Long rules go: large segments far from square."""
    return m.where(~((F.col("area") > area) & ((F.col("aspect") > aspect) | (F.col("aspect") < 1 / aspect))))


def border_points(turn: Column | None = None) -> Column:
    """How many margin points lie within 2 pixels of the margin's bounding box, after a turn if given. Linear in the margin."""

    def turned(t: Column) -> Column:
        return let(F.struct(F.cos(t).alias("c"), F.sin(t).alias("s")), lambda r: F.transform("margin", lambda p: F.struct((p["x"] * r["c"] - p["y"] * r["s"]).alias("x"), (p["x"] * r["s"] + p["y"] * r["c"]).alias("y"))))

    def count(points: Column) -> Column:
        side = lambda f, k: f(F.transform(points, lambda p: p[k]))
        box = F.struct(side(F.array_min, "x").alias("x1"), side(F.array_min, "y").alias("y1"), side(F.array_max, "x").alias("x2"), side(F.array_max, "y").alias("y2"))
        near = lambda p, b: (p["x"] - b["x1"] < 2) | (b["x2"] - p["x"] < 2) | (p["y"] - b["y1"] < 2) | (b["y2"] - p["y"] < 2)
        return let(box, lambda b: F.size(F.filter(points, lambda p: near(p, b))))

    return count(F.col("margin")) if turn is None else let(let(turn, turned), count)


def frame_turn() -> Column:
    """The turn that sets a frame upright: from its leftmost margin point to its topmost one; 0 beyond 10 degrees."""
    top = F.array_min(F.transform("margin", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    right = F.array_max(F.transform("margin", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    turn = -F.atan2((right["y"] - top["y"]).cast("double"), (right["x"] - top["x"]).cast("double"))
    return F.when(F.abs(turn) < np.pi / 18, turn).otherwise(0.0)


def without_tables(m: DataFrame, margin: int = 300, border: int = 3000, fill: float = 0.2) -> DataFrame:
    """Frames go: sparse, roughly square segments most of whose margin runs along their bounding box, upright or turned a little."""
    frame = (F.size("margin") > margin) & F.col("aspect").between(0.1, 10) & (F.col("fill") <= fill)
    table = (2 * border_points() > border) | (2 * border_points(frame_turn()) > border)
    return m.where(~(frame & table))


def distances(m: DataFrame, reach: int = MAX_DIST) -> DataFrame:
    """doc_id, page_no, id1, id2, d, ratio: pairs of segments with margins nearer than `reach`, by Chebyshev distance of points.

    Margin points are joined by grid cell, then reduced to the least distance of a pair.
    """
    keys = ["doc_id", "page_no"]
    pts = m.select(*keys, F.col("segment_id").alias("id"), F.explode("margin").alias("p")).select(*keys, "id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    near = spatial.near_pairs(pts, pts, reach, keys=keys, ordered=True).groupBy(*keys, "id1", "id2").agg(F.min("d").alias("d"))
    a = m.select(*keys, F.col("segment_id").alias("id1"), F.col("area").alias("a1"))
    b = m.select(*keys, F.col("segment_id").alias("id2"), F.col("area").alias("a2"))
    ratio = F.expr("cast(greatest(a1, a2) div least(a1, a2) AS int)")
    return near.join(a, [*keys, "id1"]).join(b, [*keys, "id2"]).withColumn("ratio", ratio).drop("a1", "a2")


def clusters(m: DataFrame, near: DataFrame, dist: Column | int) -> DataFrame:
    """m with `cluster`: segments nearer than dist hang together; the cluster is its smallest segment."""
    keys = ["doc_id", "page_no"]
    edges = near.where(F.col("d") < dist).select(*keys, F.col("id1").alias("a"), F.col("id2").alias("b"))
    found = graph.components(edges, keys).select(*keys, F.col("node").alias("segment_id"), "component")
    return m.join(found, [*keys, "segment_id"], "left").withColumn("cluster", F.coalesce("component", "segment_id")).drop("component")


def without_text(c: DataFrame, size: int = 8) -> DataFrame:
    """Clusters of more than `size` segments go if they are long lines or have no sparse segment."""
    keys = ["doc_id", "page_no", "cluster"]
    sparse = F.bool_or((F.col("fill") < 0.2) & F.col("aspect").between(0.1, 10))
    box = c.groupBy(*keys).agg(F.count("*").alias("n"), sparse.alias("sparse"), (F.max("y2") - F.min("y1")).alias("h"), (F.max("x2") - F.min("x1")).alias("w"))
    line = ~F.coalesce(F.try_divide(F.col("h").cast("double"), F.col("w")).between(0.1, 10), F.lit(False))
    return c.join(box.where((F.col("n") > size) & (line | ~F.col("sparse"))).select(*keys), keys, "left_anti")


def entropy_index(near: DataFrame) -> DataFrame:
    """doc_id, page_no, index: the size ratio whose row of distances has the largest entropy of empty bins; text stands at high ones."""
    keys = ["doc_id", "page_no"]
    cells = near.where(F.col("ratio") < MAX_RATIO).withColumn("page", F.struct(*keys)).withColumn("row", F.struct(*keys, "ratio"))
    rows = stats.empty_share_entropy(cells, "row", "d", MAX_DIST).select("row.*", F.round("entropy", 9).alias("entropy"))
    return rows.groupBy(*keys).agg((-F.max(F.struct("entropy", (-F.col("ratio")).alias("early")))["early"]).alias("index"))


def drawing_boxes(c: DataFrame) -> DataFrame:
    """doc_id, page_no, box_id, x1, y1, x2, y2, n (pixels) of the clusters with a segment that looks like a drawing.

    box_id counts in reading order on the page: by top, left, bottom, right.
    """
    keys = ["doc_id", "page_no", "cluster"]
    good = F.bool_or((F.col("fill") > 0) & (F.col("fill") < 0.2) & (F.col("aspect") > 0.1) & (F.col("aspect") < 10))
    box = c.groupBy(*keys).agg(good.alias("good"), *[f(n).alias(n) for f, n in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))], F.sum("area").alias("n"))
    order = Window.partitionBy("doc_id", "page_no").orderBy("y1", "x1", "y2", "x2", "cluster")
    return box.where("good").withColumn("box_id", (F.row_number().over(order) - 1).cast("int")).drop("good", "cluster")


def segment_pages(pages: DataFrame) -> DataFrame:
    """drawing_boxes of pages: components, separators, tables, text, clusters."""
    return boxes_of_segments(find_segments(pages))


def boxes_of_segments(segments: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """drawing_boxes of SEGMENTS, but for those in `without` (doc_id, page_no, segment_id)."""
    from ..sources.storage import cut

    if without is not None:
        segments = segments.join(without, ["doc_id", "page_no", "segment_id"], "left_anti")
    m = cut(without_tables(without_separators(measured(segments))))
    near = cut(distances(m))  # both are used several times
    busy = m.groupBy("doc_id", "page_no").count().where("count > 100").drop("count")
    texty = entropy_index(near).where("index > 4").join(busy, ["doc_id", "page_no"], "left_semi").select("doc_id", "page_no")
    lines = clusters(m.join(texty, ["doc_id", "page_no"], "left_semi"), near.join(texty, ["doc_id", "page_no"], "left_semi"), 12)
    kept = m.join(texty, ["doc_id", "page_no"], "left_anti").unionByName(without_text(lines).drop("cluster"))
    return drawing_boxes(clusters(kept, near, MAX_DIST))


def skipped_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page_no: the pages with over MOST_SEGMENTS segments, of which segment_pages has nothing."""
    return find_segments(pages).where("skipped").select("doc_id", "page_no")


def polar_profile(points: np.ndarray, bins: int = 50) -> np.ndarray:
    """Counts of points by direction from their whole-number centroid."""
    cx, cy = points.sum(axis=0) // len(points)
    turn = (np.arctan2(points[:, 1] - cy, points[:, 0] - cx) + np.pi) / (2 * np.pi) * bins
    return np.bincount(np.minimum(turn.astype(int), bins - 1), minlength=bins)


def peaks(hist: np.ndarray, level: int = 4) -> list[int]:
    """Bins that stand out: at least 1/level of the top one, and no lower than both neighbours."""
    n = len(hist)
    return [k for k in range(n) if hist[k] * level >= hist.max() and hist[k] >= hist[k - 1] and hist[k] > hist[(k + 1) % n]]


def bulge(tail: np.ndarray, head: np.ndarray, points: np.ndarray) -> bool:
    """Whether a line's profile from tail to head is flat and then has one peak of half as much again: an arrow's head."""
    axis = (head - tail) / max(np.linalg.norm(head - tail), 1e-9)
    at = np.round((points - tail) @ axis).astype(int)
    at = at[at >= 0]
    hist = np.bincount(at) if len(at) else np.zeros(1)
    n = len(hist)
    if n < 10:
        return False
    shaft, front = hist[: n // 2], hist[n // 2 :]
    level = np.median(shaft)
    return bool(abs(shaft[2:] - level).max() <= 2 and front.max() >= 1.5 * hist.mean() and front.max() > level)


def symbol(points: np.ndarray) -> dict | None:
    """An arrow (head, tail) or a plus (centre) that a segment is, else None."""
    hist = polar_profile(points)
    top = peaks(hist)
    n, centre = len(hist), points.mean(axis=0)
    if len(top) == 2 and abs(abs(top[0] - top[1]) - n // 2) <= 1:
        far = points[np.argmax(((points - centre) ** 2).sum(axis=1))]
        other = points[np.argmax(((points - far) ** 2).sum(axis=1))]
        for head, tail in ((far, other), (other, far)):
            if bulge(tail.astype(float), head.astype(float), points):
                return {"kind": "arrow", "head": head.tolist(), "tail": tail.tolist()}
    if len(top) == 4 and all(abs((top[(k + 1) % 4] - top[k]) % n - n / 4) <= 1.5 for k in range(4)):
        w, h = np.ptp(points, axis=0) + 1
        arms = [(k + j) % n for k in top for j in (-2, -1, 0, 1, 2)]  # a stroke of some pixels spreads around its peak
        if 0.7 < w / h < 1.4 and hist[arms].sum() >= 0.75 * hist.sum():
            return {"kind": "plus", "centre": centre.round().astype(int).tolist()}
    return None


def find_symbols(segments: DataFrame) -> DataFrame:
    """doc_id, page_no, segment_id, kind, head_x, head_y, tail_x, tail_y: arrows and pluses; a plus has its centre twice."""

    def run(batches):
        for pdf in batches:
            rows = []
            for s in pdf.itertuples():
                if len(s.points) < 20:
                    continue
                got = symbol(np.array([(p["x"], p["y"]) for p in s.points]))
                if got:
                    head, tail = (got["head"], got["tail"]) if got["kind"] == "arrow" else (got["centre"], got["centre"])
                    rows.append((s.doc_id, s.page_no, s.segment_id, got["kind"], *head, *tail))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "segment_id", "kind", "head_x", "head_y", "tail_x", "tail_y"])

    return segments.select("doc_id", "page_no", "segment_id", "points").mapInPandas(run, "doc_id long, page_no int, segment_id int, kind string, head_x int, head_y int, tail_x int, tail_y int")
