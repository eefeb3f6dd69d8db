"""Glyphs against bonds: which ink is a character's and which a bond's, as set operators on (keys, ...) tables of a drawing.

Where a stroke may belong to several letters and a letter to several strokes, both sides state their nearest, and mutual choices are taken, round by round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import along_line, beyond_line, distance, offset_from_line
from . import graph, spatial

#: Fixed limits of the recognition, in pixels: a stroke shorter than this is none; an upright one leans less.
DISPLACEMENT = 3.0
#: The shares of a letter's width and height that its subscripts keep to: how far they may reach back, how far they may stand off, how far they may hang down.
BACK, OFF, DOWN = 0.25, 1.0, 0.5


def mutual_best(pairs: DataFrame, keys: list[str], left: str, right: str, d: str, cut=None) -> DataFrame:
    """keys, left, right, d: the pairs in which each is the nearest of all that are still free for the other, then the same among the rest, until
    none is left. Ties go to the smaller right, then to the smaller left.
    """
    if cut is None:
        from ..sources.storage import cut
    keys, out = list(keys), None
    rest = cut(pairs.select(*keys, left, right, d))
    while rest.head(1):
        best_right = rest.groupBy(*keys, left).agg(F.min(F.struct(d, right)).alias("r")).select(*keys, left, F.col(f"r.{right}").alias(right))
        best_left = rest.groupBy(*keys, right).agg(F.min(F.struct(d, left)).alias("l")).select(*keys, F.col(f"l.{left}").alias(left), right)
        both = cut(rest.join(best_right, [*keys, left, right], "left_semi").join(best_left, [*keys, left, right], "left_semi"))
        out = both if out is None else out.unionByName(both)
        rest = cut(rest.join(both.select(*keys, left), [*keys, left], "left_anti").join(both.select(*keys, right), [*keys, right], "left_anti"))
    return rest if out is None else out


def bonds_outside_glyphs(bonds: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """bonds (keys, bond_idx, x1, y1, x2, y2, ...) but for those with both ends in one glyph's box (keys, box, x1, y1, x2, y2)."""
    ends = [spatial.inside_boxes(bonds.select(*keys, F.col("bond_idx").alias("id"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")), boxes, keys) for k in (1, 2)]
    inside = ends[0].join(ends[1], [*keys, "id", "box"]).select(*keys, F.col("id").alias("bond_idx"))
    return bonds.join(inside, [*keys, "bond_idx"], "left_anti")


def stroke_letters(bonds: DataFrame, letters: DataFrame, keys: list[str], low: float, high: float, cut=None) -> DataFrame:
    """keys, bond_idx, a, x, y, r: lone single strokes that are the `l` of a letter's symbol, or an `I`.

    bonds: keys, bond_idx, x1, y1, x2, y2, type, alone; letters: keys, letter_idx, x, y, r. A stroke is longer than `low` and shorter than `high`, and higher than wide. It is an
    `l` if it touches a letter's circle at about its height; a letter has one such stroke and a stroke one letter, nearest first. It is an
    `I` if it stands upright and no letter is in line with it above or below.
    """
    c, keys = F.col, list(keys)
    tall = bonds.where((c("type") == 1) & c("alone") & (F.abs(c("x1") - c("x2")) < F.abs(c("y1") - c("y2")))).withColumn("size", distance(c("x1"), c("y1"), c("x2"), c("y2")))
    tall = tall.where((c("size") > low) & (c("size") < high)).select(*keys, c("bond_idx").alias("id"), ((c("x1") + c("x2")) / 2).alias("x"), ((c("y1") + c("y2")) / 2).alias("y"), "x1", "y1", "x2", "y2", "size")
    marks = letters.select(*keys, c("letter_idx").alias("id"), "x", "y")
    met = spatial.near_pairs(tall, marks, 2 * high, distance, keys)
    met = met.join(tall.select(*keys, c("id").alias("id1"), *[c(n) for n in ("x1", "y1", "x2", "y2", "size")], c("y").alias("sy")), [*keys, "id1"]).join(letters.select(*keys, c("letter_idx").alias("id2"), "x", "y", "r"), [*keys, "id2"])
    beside = met.where((c("d") < c("size") / 2 + c("r")) & (F.abs(c("sy") - c("y")) < F.least(c("size") / 2, c("r"))))
    claimed = mutual_best(beside.select(*keys, c("id1").alias("stroke"), c("id2").alias("letter"), F.round("d", 6).alias("d")), keys, "stroke", "letter", "d", cut)
    claimed = claimed.select(*keys, c("stroke").alias("id"), F.lit("l").alias("a"))
    line = (c("x1"), c("y1"), c("x2"), c("y2"), c("x"), c("y"))
    ends = F.least(F.abs(along_line(*line)), F.abs(beyond_line(*line))) - c("r")
    in_line = met.where((ends <= c("size") / 2) & (F.abs(offset_from_line(*line)) <= c("r") / 2)).select(*keys, c("id1").alias("id"))
    upright = tall.where((F.abs(c("x1") - c("x2")) < DISPLACEMENT) & (F.abs(c("y1") - c("y2")) > low))
    alone = upright.join(in_line, [*keys, "id"], "left_anti").join(claimed, [*keys, "id"], "left_anti").select(*keys, "id", F.lit("I").alias("a"))
    named = claimed.unionByName(alone)
    return tall.join(named, [*keys, "id"]).select(*keys, c("id").alias("bond_idx"), "a", "x", "y", (c("size") / 2).alias("r"))


def bonds_left(bonds: DataFrame, strokes: DataFrame, keys: list[str]) -> DataFrame:
    """bonds without `stroke_letters` and without single ones shorter than DISPLACEMENT."""
    c = F.col
    size = distance(c("x1"), c("y1"), c("x2"), c("y2"))
    return bonds.where(~((c("type") == 1) & (size < DISPLACEMENT))).join(strokes.select(*keys, "bond_idx"), [*keys, "bond_idx"], "left_anti")


def unread_groups(bonds: DataFrame, keys: list[str], width: float, height: float, size: int, cut=None) -> DataFrame:
    """keys, component, x, y, r, x1, y1, x2, y2, n: connected bonds (keys, a, b, x1, y1, x2, y2) of a character's size, more than `size` of them, that nobody has read.

    They stand for `*`; `component` is the smallest atom, so the bonds that go are those with an end in it.
    """
    c, keys = F.col, list(keys)
    part = graph.components(bonds.select(*keys, "a", "b"), keys, cut)
    own = bonds.join(part.select(*keys, c("node").alias("a"), "component"), [*keys, "a"])
    low, high = (lambda k, f=f, g=g: f(g(f"{k}1", f"{k}2")) for f, g in ((F.min, F.least), (F.max, F.greatest)))
    box = own.groupBy(*keys, "component").agg(low("x").alias("x1"), low("y").alias("y1"), high("x").alias("x2"), high("y").alias("y2"), F.count("*").alias("n"))
    few = box.where((c("x2") - c("x1") < width) & (c("y2") - c("y1") < height) & (c("n") > size))
    return few.select(*keys, "component", ((c("x1") + c("x2")) / 2).alias("x"), ((c("y1") + c("y2")) / 2).alias("y"), (distance(c("x1"), c("y1"), c("x2"), c("y2")) / 2).alias("r"), "x1", "y1", "x2", "y2", "n")


def without_short_ends(atoms: DataFrame, bonds: DataFrame, keys: list[str], cut=None) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) without short plain ends: all at once, then those that are ends now, until none is left.

    atoms: keys, atom_idx, label, ...; bonds: keys, bond_idx, a, b, type, hash, wedge, arom, length, average, ... An end is a single bond with no mark, shorter than half the
    average, one of whose atoms has no other bond. That atom goes with it; the other, if it has no label, takes its label, of several that of the
    first bond, or `Xx`, which a hash bond prevents. Both atoms of a bond by itself go.
    """
    if cut is None:
        from ..sources.storage import cut
    c, keys = F.col, list(keys)
    bonds, atoms = cut(bonds), cut(atoms)
    blank = F.trim(F.coalesce("label", F.lit(""))) == ""
    while True:
        degree = graph.degrees(bonds, keys).select(*keys, "atom_idx", "degree")
        at = lambda end: degree.select(*keys, c("atom_idx").alias(end), c("degree").alias(f"of_{end}"))
        short = bonds.where((c("type") == 1) & ~c("hash") & ~c("wedge") & ~c("arom") & (c("length") < c("average") / 2)).select(*keys, "bond_idx", "a", "b")
        ends = cut(short.join(at("a"), [*keys, "a"]).join(at("b"), [*keys, "b"]).where("of_a = 1 or of_b = 1"))
        if not ends.head(1):
            return atoms, bonds
        leaf = F.explode(F.filter(F.array(F.struct(c("a").alias("leaf"), c("b").alias("base"), c("of_a").alias("n")), F.struct(c("b").alias("leaf"), c("a").alias("base"), c("of_b").alias("n"))), lambda x: x["n"] == 1))
        gone = ends.select(*keys, "bond_idx", leaf.alias("x")).select(*keys, "bond_idx", "x.leaf", "x.base")
        named = gone.join(atoms.select(*keys, c("atom_idx").alias("leaf"), F.when(~blank, c("label")).alias("said")), [*keys, "leaf"])
        bonds = cut(bonds.join(ends.select(*keys, "bond_idx"), [*keys, "bond_idx"], "left_anti"))
        dashed = graph.ends(bonds.where("hash"), keys).distinct().withColumn("dashed", F.lit(True))
        said = named.groupBy(*keys, c("base").alias("atom_idx")).agg(F.min_by("said", F.when(c("said").isNotNull(), c("bond_idx"))).alias("said")).withColumn("base", F.lit(True))
        left = atoms.join(gone.select(*keys, c("leaf").alias("atom_idx")), [*keys, "atom_idx"], "left_anti").join(said, [*keys, "atom_idx"], "left").join(dashed, [*keys, "atom_idx"], "left")
        label = F.when(c("base") & blank, F.coalesce("said", F.when(c("dashed"), c("label")).otherwise("Xx"))).otherwise(c("label"))
        atoms = cut(left.withColumn("label", label).select(*atoms.columns))


def _behind(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, box, x1, y1, x2, y2: where a glyph's subscripts begin: from a little before its right edge, from its middle down."""
    c = F.col
    w, h = c("x2") - c("x1") + 1, c("y2") - c("y1") + 1
    return glyphs.select(*keys, c("glyph_idx").alias("box"), (c("x2") - w * BACK).alias("x1"), ((c("y1") + c("y2")) / 2).alias("y1"), (c("x2") + w * OFF).alias("x2"), (c("y2") + h * DOWN).alias("y2"))


def subscripts(glyphs: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mark, glyph: the letter of `glyphs` behind which each of `marks` stands, if one does. Both: keys, glyph_idx, a, x1, y1, x2, y2.

    Seen from the letter a mark begins, at half its height, within the letter's subscript box; of several letters the one whose right edge is nearest has it, then
    the smaller. A letter may have many marks, a mark has one letter.
    """
    c, keys = F.col, list(keys)
    points = marks.select(*keys, c("glyph_idx").alias("id"), c("x1").alias("x"), ((c("y1") + c("y2")) / 2).alias("y"))
    met = spatial.inside_boxes(points, _behind(glyphs, keys), keys).join(points, [*keys, "id"]).join(glyphs.select(*keys, c("glyph_idx").alias("box"), c("x2").alias("edge")), [*keys, "box"])
    best = F.min(F.struct(F.abs(c("x") - c("edge")).alias("d"), "box")).alias("m")
    return met.where("id <> box").groupBy(*keys, "id").agg(best).select(*keys, c("id").alias("mark"), c("m.box").alias("glyph"))


def digit_sizes(glyphs: DataFrame, keys: list[str], most: tuple[float, float]) -> DataFrame:
    """keys, digit_w, digit_h: the upper median width and height of the digits 2 to 9 of a drawing that has three or more, `most` at most."""
    c = F.col
    d = glyphs.where(c("a").between("2", "9") & (F.length("a") == 1)).select(*keys, (c("x2") - c("x1") + 1).alias("w"), (c("y2") - c("y1") + 1).alias("h"))
    middle = lambda n: F.element_at(F.array_sort(F.collect_list(n)), (F.count("*") / 2).cast("int") + 1)  # noqa: E731  a drawing has few digits
    return d.groupBy(*keys).agg(F.count("*").alias("n"), *[F.least(middle(k), F.lit(m)).alias(f"digit_{k}") for k, m in zip("wh", most, strict=True)]).where("n > 2").drop("n")


def ones(glyphs: DataFrame, unread: DataFrame, keys: list[str], most: tuple[float, float]) -> DataFrame:
    """unread (keys, glyph_idx, x1, y1, x2, y2) as `1` in a column a: upright strokes no larger than the drawing's digits that stand where a letter's subscript would."""
    c, keys = F.col, list(keys)
    w, h = c("x2") - c("x1") + 1, c("y2") - c("y1") + 1
    thin = unread.join(digit_sizes(glyphs, keys, most), keys).where((w <= c("digit_w")) & (h <= c("digit_h")) & (h > 2 * w)).drop("digit_w", "digit_h")
    behind = subscripts(glyphs.where(c("a").rlike("^[A-Za-z]")), thin.withColumn("a", F.lit("1")), keys)
    return thin.join(behind.select(*keys, c("mark").alias("glyph_idx")), [*keys, "glyph_idx"], "left_semi").withColumn("a", F.lit("1"))


def numbered(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """glyphs (keys, glyph_idx, a, x1, y1, x2, y2) with digits taken into the letters before them: `a` of a letter goes on with its digits from left to right.

    A digit goes to the letter or digit it stands behind, and with that digit to its letter; digits that stand by themselves stay.
    """
    c, keys = F.col, list(keys)
    digit = c("a").rlike("^[0-9]$")
    letters, digits = glyphs.where(~digit), glyphs.where(digit)
    first = subscripts(letters, digits, keys)
    # the digits of a number stand beside one another: the next begins within a width of the last
    left = digits.join(first.select(*keys, c("mark").alias("glyph_idx")), [*keys, "glyph_idx"], "left_anti")
    level = lambda d: d.select(*keys, "glyph_idx", "a", "x1", (c("y1") - (c("y2") - c("y1"))).alias("y1"), "x2", "y2")  # noqa: E731  also level with it
    taken = digits.join(first.select(*keys, c("mark").alias("glyph_idx"), "glyph"), [*keys, "glyph_idx"])
    while True:
        more = subscripts(level(taken.drop("glyph")), left, keys)
        more = more.join(taken.select(*keys, c("glyph_idx").alias("glyph"), c("glyph").alias("letter")), [*keys, "glyph"]).select(*keys, c("mark").alias("glyph_idx"), c("letter").alias("glyph"))
        from ..sources.storage import cut

        fresh = cut(left.join(more, [*keys, "glyph_idx"]))
        if not fresh.head(1):
            break
        left = cut(left.join(fresh.select(*keys, "glyph_idx"), [*keys, "glyph_idx"], "left_anti"))
        taken = cut(taken.unionByName(fresh))
    tail = taken.groupBy(*keys, c("glyph").alias("glyph_idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "glyph_idx", "a"))), lambda x: x["a"]), "").alias("tail"), F.max("x2").alias("tail_x2"))
    grown = letters.join(tail, [*keys, "glyph_idx"], "left").withColumn("a", F.concat("a", F.coalesce("tail", F.lit("")))).withColumn("x2", F.greatest("x2", F.coalesce("tail_x2", "x2"))).drop("tail", "tail_x2")
    return grown.select(*glyphs.columns).unionByName(left.select(*glyphs.columns))
