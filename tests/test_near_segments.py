import math
import random

from inkgraph.operators import spatial


def test_few_and_many_points_meet_alike(spark):
    """Segments meet the points of graphs with few of them by keys, those of others by cells; graphs of both kinds side by side."""
    rng = random.Random(11)
    points = [(g, k, rng.uniform(-20, 60), rng.uniform(-20, 60)) for g, n in ((1, 5), (2, 40), (3, 12)) for k in range(n)]
    lines = [(g, k, *(rng.uniform(-20, 60) for _ in range(4)), f"s{k}") for g in (1, 2, 3, 4) for k in range(12)] + [(1, 99, 1.0, 1.0, 1.0, 1.0, "none")]
    p = spark.createDataFrame(points, "page int, id int, x double, y double")
    s = spark.createDataFrame(lines, "page int, id int, x1 double, y1 double, x2 double, y2 double, name string")
    want = set()
    for g, k, x1, y1, x2, y2, name in lines:
        size = math.dist((x1, y1), (x2, y2))
        for h, i, x, y in points:
            if g == h and size > 0:
                along, off = ((x2 - x1) * (x - x1) + (y2 - y1) * (y - y1)) / size, ((y2 - y1) * (x - x1) - (x2 - x1) * (y - y1)) / size
                if 0 <= along <= size and abs(off) < 4:
                    want.add((g, i, k, name))
    for few in (0, 12, 100):
        got = [(r.page, r.id1, r.id2, r.name) for r in spatial.near_segments(p, s, 4.0, ["page"], ["name"], few).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len({w[0] for w in want}) == 3
