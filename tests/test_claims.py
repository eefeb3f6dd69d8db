import itertools
import math
import random

import numpy as np
import pytest

from drawn import LETTERS
from inkgraph.operators import claims, glyphs

BONDS = "page int, bond_idx int, a int, b int, x1 double, y1 double, x2 double, y2 double, type int, hash boolean, wedge boolean, arom boolean, alone boolean, length double, average double"


def bond(page, k, x1, y1, x2, y2, a=0, b=0, type=1, hash=False, wedge=False, alone=True, average=40.0):
    return (page, k, a, b, float(x1), float(y1), float(x2), float(y2), type, hash, wedge, False, alone, math.dist((x1, y1), (x2, y2)), average)


def test_the_l_of_cl_is_no_bond_and_a_lone_stroke_is_iodine(spark):
    letters = spark.createDataFrame([(1, 0, 20.0, 50.0, 8.0), (1, 1, 200.0, 50.0, 8.0)], "page int, letter_idx int, x double, y double, r double")
    bonds = [
        bond(1, 0, 32, 42, 32, 58),  # the l of the first letter
        bond(1, 1, 35, 42, 35, 58),  # farther from it: not its second l; upright with no letter above or below: I
        bond(1, 2, 100, 40, 101, 56),  # by itself
        bond(1, 3, 200, 62, 200, 78),  # below the second letter, in line with it: a bond
        bond(1, 4, 60, 50, 110, 50), bond(1, 5, 32, 42, 33, 58, alone=False), bond(1, 6, 5, 5, 6, 6),
    ]
    df = spark.createDataFrame(bonds, BONDS)
    found = claims.stroke_letters(df, letters, ["page"], 8.0, 22.0)
    assert {(r.bond_idx, r.a, r.x, r.y, r.r) for r in found.collect()} == {(0, "l", 32.0, 50.0, 8.0), (1, "I", 35.0, 50.0, 8.0), (2, "I", 100.5, 48.0, math.dist((0, 0), (1, 16)) / 2)}
    assert {r.bond_idx for r in claims.bonds_left(df, found, ["page"]).collect()} == {3, 4, 5}


@pytest.mark.parametrize("seed", [1, 2])
def test_mutual_choices_equal_the_greedy_ones(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(1, 2), i, j, float(rng.randint(0, 8))) for i, j in itertools.product(range(12), range(12)) if rng.random() < 0.4]
    got = claims.mutual_best(spark.createDataFrame(pairs, "page int, l int, r int, d double"), ["page"], "l", "r", "d")
    rows = [tuple(x) for x in got.collect()]
    for page in (1, 2):
        mine = [x for x in rows if x[0] == page]
        assert len({x[1] for x in mine}) == len(mine) == len({x[2] for x in mine}) and set(mine) <= set(pairs)
        used = ({x[1] for x in mine}, {x[2] for x in mine})
        for p, i, j, d in pairs:  # no pair would both rather have each other
            if p == page:
                assert i in used[0] or j in used[1]
                other = [x[3] for x in mine if x[1] == i or x[2] == j]
                assert min(other) <= d
    assert claims.mutual_best(spark.createDataFrame([], "page int, l int, r int, d double"), ["page"], "l", "r", "d").count() == 0


def test_bonds_inside_a_glyph_go(spark):
    df = spark.createDataFrame([bond(1, 0, 2, 2, 8, 8), bond(1, 1, 2, 2, 30, 8), bond(2, 2, 2, 2, 8, 8), bond(1, 3, 5, 5, 25, 5)], BONDS)
    boxes = spark.createDataFrame([(1, 0, 0, 0, 10, 12), (1, 1, 20, 0, 28, 12)], "page int, box int, x1 int, y1 int, x2 int, y2 int")
    assert {r.bond_idx for r in claims.bonds_outside_glyphs(df, boxes, ["page"]).collect()} == {1, 2, 3}


def test_small_groups_nobody_read(spark):
    small = [bond(1, k, *p, *q, a=k, b=k + 1) for k, (p, q) in enumerate(zip([(0, 0), (5, 1), (6, 8)], [(5, 1), (6, 8), (1, 9)], strict=True))]
    large = [bond(1, 10 + k, 50 * k, 60, 50 * k + 50, 60, a=20 + k, b=21 + k) for k in range(4)]
    df = spark.createDataFrame(small + large + [bond(2, 0, 0, 0, 4, 4, a=1, b=2)], BONDS)
    (got,) = claims.unread_groups(df, ["page"], 12.0, 14.0, 2).collect()
    assert (got.page, got.component, got.x, got.y, got.n) == (1, 0, 3.0, 4.5, 3) and (got.x1, got.y1, got.x2, got.y2) == (0, 0, 6, 9)


def test_short_ends_go_and_hand_on_their_labels(spark):
    at = [(0, 0), (40, 0), (55, 0), (0, 40), (0, 52), (0, 60), (80, 80), (90, 80), (40, 40), (40, 55)]
    ends = [(0, 1), (1, 2), (0, 3), (3, 4), (4, 5), (6, 7), (1, 8), (8, 9)]
    label = {2: "O", 4: " ", 5: " ", 9: " "}
    bonds = [bond(1, k, *at[a], *at[b], a=a, b=b) for k, (a, b) in enumerate(ends)]
    bonds[6] = bond(1, 6, *at[1], *at[8], a=1, b=8, hash=True)
    atoms = spark.createDataFrame([(1, k, float(x), float(y), label.get(k, " ")) for k, (x, y) in enumerate(at)], "page int, atom_idx int, x double, y double, label string")
    left, rest = claims.without_short_ends(atoms, spark.createDataFrame(bonds, BONDS), ["page"])
    assert {r.bond_idx for r in rest.collect()} == {0, 2, 6}  # the end of 3-4-5 in two rounds, the pair 6-7 at once
    assert {r.atom_idx: r.label for r in left.collect()} == {0: " ", 1: "O", 3: "Xx", 8: " "}


GLYPHS = "page int, glyph_idx int, a string, x1 int, y1 int, x2 int, y2 int"


def test_formulas_from_separate_glyphs(spark):
    def row(text, x, y, first):
        out = []
        for k, ch in enumerate(text):
            low = ch.isdigit()
            out.append((1, first + k, ch, x, y + (8 if low else 0), x + (5 if low else 7), y + (16 if low else 11)))
            x += 7 if low else 10
        return out

    rows = row("CH3", 10, 10, 0) + row("NO2", 100, 10, 10) + row("C12H25", 10, 80, 20) + [(1, 40, "7", 300, 300, 305, 308)]
    got = claims.numbered(spark.createDataFrame(rows, GLYPHS), ["page"]).collect()
    assert {r.glyph_idx: r.a for r in got} == {0: "C", 1: "H3", 10: "N", 11: "O2", 20: "C12", 23: "H25", 40: "7"}
    letters = spark.createDataFrame([(1, r.glyph_idx, r.a, (r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2, 7.0) for r in got if r.glyph_idx < 20], "page int, letter_idx int, a string, x double, y double, r double")
    assert sorted(r.a for r in glyphs.assemble_labels(letters, ["page"]).collect()) == ["CH3", "NO2"]


def test_thin_strokes_become_ones_where_digits_are_known(spark):
    read = [(1, 0, "C", 10, 10, 17, 21)] + [(1, 1 + k, str(2 + k), 40 + 20 * k, 40, 45 + 20 * k, 48) for k in range(3)] + [(2, 0, "C", 10, 10, 17, 21)]
    unread = [(1, 50, 19, 18, 20, 25), (1, 51, 100, 100, 101, 107), (1, 52, 19, 18, 20, 40), (2, 50, 19, 18, 20, 25)]  # page 2 has no digits to go by
    got = claims.ones(spark.createDataFrame(read, GLYPHS), spark.createDataFrame(unread, "page int, glyph_idx int, x1 int, y1 int, x2 int, y2 int"), ["page"], (20.0, 22.0))
    assert [(r.page, r.glyph_idx, r.a) for r in got.collect()] == [(1, 50, "1")]


def block(text, gap):
    parts = [np.kron(np.array([[c == "#" for c in line] for line in LETTERS[ch]]), np.ones((2, 2), bool)) for ch in text]
    out = parts[0]
    for p in parts[1:]:
        out = np.concatenate([out, np.zeros((18, gap), bool), p], axis=1) if gap >= 0 else np.concatenate([out[:, :gap], out[:, gap:] | p[:, :-gap], p[:, -gap:]], axis=1)
    return out


@pytest.mark.parametrize(("text", "gap"), [("HL", 0), ("LT", 0), ("THL", 0), ("TL", 1), ("HT", 0)])
def test_touching_letters_are_read(spark, text, gap):
    reader = glyphs.template_reader({c: block(c, 0) for c in LETTERS}, 0.85)
    mask = block(text, gap)
    assert reader(mask) == glyphs.UNKNOWN
    assert "".join(c for c, _, _ in glyphs.split_fused(mask, reader, 6, 20)) == text
    df = spark.createDataFrame([(7, mask.shape[0], mask.shape[1], (mask * 255).astype(np.uint8).tobytes())], "id int, height int, width int, ink binary")
    got = sorted((r.first, r.a, r.id) for r in glyphs.fused_glyphs(df, reader, 6, 20).collect())
    assert [a for _, a, _ in got] == list(text) and {i for _, _, i in got} == {7}


def test_nothing_is_read_where_no_window_is_known():
    noise = np.random.default_rng(1).random((18, 60)) < 0.5
    assert glyphs.split_fused(noise, lambda m: glyphs.UNKNOWN, 6, 20) == []
