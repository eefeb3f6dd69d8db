import itertools
import math
import random

import pytest

from inkgraph.operators import agents, spatial

GLYPHS = "page int, glyph_id int, a string, x1 int, y1 int, x2 int, y2 int"
ARROWS = "page int, arrow_id int, tail_x int, tail_y int, head_x int, head_y int"


def written(text, x, y, start, step=9, size=(7, 11)):
    """Glyphs of a line of text; a space leaves a gap."""
    return [(start + k, ch, x + k * step, y, x + k * step + size[0] - 1, y + size[1] - 1) for k, ch in enumerate(text) if ch != " "]


def test_two_words_above_and_one_below(spark):
    glyphs = written("HCl aq", 62, 80, 0) + written("80C", 75, 112, 20) + written("N", 20, 300, 40)
    df = spark.createDataFrame([(1, *g) for g in glyphs], GLYPHS)
    for head, tail in (((150, 104), (40, 104)), ((40, 104), (150, 104))):  # whichever way the arrow points
        arrows = spark.createDataFrame([(1, 0, *tail, *head), (1, 1, 300, 300, 420, 300), (2, 0, 0, 0, 100, 0)], ARROWS)
        got = agents.agent_strings(df, arrows, ["page"]).collect()
        assert sorted((r.page, r.arrow_id, r.line, r.agent) for r in got) == [(1, 0, 0, "HCl aq"), (1, 0, 1, "80C")]


def test_slanted_and_upright_arrows(spark):
    turn = math.radians(30)
    flat = written("LiOH Et", 30, -18, 0)
    glyphs = []
    for i, ch, x1, y1, x2, y2 in flat:
        cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
        x, y = 200 + cx * math.cos(turn) - cy * math.sin(turn), 200 + cx * math.sin(turn) + cy * math.cos(turn)
        glyphs.append((1, i, ch, round(x - 3), round(y - 5), round(x + 3), round(y + 5)))
    arrows = [(1, 7, 200, 200, round(200 + 110 * math.cos(turn)), round(200 + 110 * math.sin(turn))), (2, 1, 50, 10, 50, 110)]
    glyphs += [(2, k, ch, 58, 20 + 13 * k, 64, 30 + 13 * k) for k, ch in enumerate("abc")]
    got = agents.agent_strings(spark.createDataFrame(glyphs, GLYPHS), spark.createDataFrame(arrows, ARROWS), ["page"]).collect()
    assert sorted((r.page, r.arrow_id, r.agent) for r in got) == [(1, 7, "LiOH Et"), (2, 1, "abc")]


def test_text_far_from_the_shaft_comes_over_what_hangs_together(spark):
    glyphs = written("abc", 60, 85, 0) + written("def", 60, 69, 10) + written("ghi", 60, 30, 20)  # the third line stands apart
    arrows = spark.createDataFrame([(1, 0, 40, 110, 150, 110)], ARROWS)
    got = agents.agent_strings(spark.createDataFrame([(1, *g) for g in glyphs], GLYPHS), arrows, ["page"]).collect()
    assert [(r.line, r.agent) for r in sorted(got, key=lambda r: r.line)] == [(0, "def"), (1, "abc")]
    assert agents.agent_strings(spark.createDataFrame([], GLYPHS), arrows, ["page"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    points = [(rng.randint(1, 2), i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(300)]
    lines = [(rng.randint(1, 2), i, *(rng.uniform(-60, 60) for _ in range(4))) for i in range(25)] + [(1, 99, 3.0, 3.0, 3.0, 3.0)]
    got = spatial.near_segments(spark.createDataFrame(points, "page int, id int, x double, y double"), spark.createDataFrame(lines, "page int, id int, x1 double, y1 double, x2 double, y2 double"), 5.0, ["page"])
    want = set()
    for (p, i, x, y), (q, j, x1, y1, x2, y2) in itertools.product(points, lines):
        size = math.dist((x1, y1), (x2, y2))
        if p == q and size and 0 <= ((x2 - x1) * (x - x1) + (y2 - y1) * (y - y1)) / size <= size and abs((y2 - y1) * (x - x1) - (x2 - x1) * (y - y1)) / size < 5:
            want.add((p, i, j))
    rows = [(r.page, r.id1, r.id2) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 100

    boxes = [(rng.randint(1, 2), i, x := rng.randint(-100, 100), y := rng.randint(-100, 100), x + rng.randint(0, 70), y + rng.randint(0, 9)) for i in range(150)]
    near = [(r.page, r.id1, r.id2) for r in spatial.near_boxes(spark.createDataFrame(boxes, "page int, id int, x1 int, y1 int, x2 int, y2 int"), 6.0, ["page"]).collect()]
    want = {(a[0], a[1], b[1]) for a, b in itertools.combinations(boxes, 2) if a[0] == b[0] and all(max(a[k], b[k]) < min(a[k + 2], b[k + 2]) + 6 for k in (2, 3))}
    assert len(near) == len(set(near)) and set(near) == want and len(want) > 50
