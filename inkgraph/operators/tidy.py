"""From a traced drawing to a molecule's graph, as sets of rows over all drawings at once.

Atoms are (keys, atom_idx, x, y, label), bonds (keys, bond_idx, a, b, type, hash, wedge, arom), drawings (keys, average), the average bond. What depends on the average is compared
in units of it, so one grid serves all drawings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cos_between, distance, offset_from_line
from ..sources.storage import cut
from . import graph, spatial, stats

BLANK = " "


def _blank(c: str):
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _at(atoms: DataFrame, keys: list[str], end: str, x: str, y: str) -> DataFrame:
    return atoms.select(*keys, F.col("atom_idx").alias(end), F.col("x").alias(x), F.col("y").alias(y))


def united(atoms: DataFrame, bonds: DataFrame, links: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) with atoms that hang together over links (keys, a, b) as one, the smallest, at the mean of all, with the first label among them.

    Bonds follow; of those with the same ends then the first stays.
    """
    c = F.col
    part = cut(graph.components(links, keys).select(*keys, c("node").alias("atom_idx"), c("component").alias("root")))
    whole = atoms.join(part, [*keys, "atom_idx"], "left").groupBy(*keys, F.coalesce("root", "atom_idx").alias("atom_idx"))
    label = F.coalesce(F.min_by("label", F.when(~_blank("label"), c("atom_idx"))), F.lit(BLANK)).alias("label")
    one = whole.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), label)
    for end in ("a", "b"):
        bonds = bonds.join(part.select(*keys, c("atom_idx").alias(end), c("root").alias("_root")), [*keys, end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    return cut(one), cut(graph.distinct_bonds(bonds, keys))


def near_united(atoms: DataFrame, bonds: DataFrame, reach: float, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) with atoms joined by steps shorter than `reach` as one."""
    points = atoms.select(*keys, F.col("atom_idx").alias("id"), "x", "y")
    near = spatial.near_pairs(points, points, reach, distance, keys, ordered=True)
    return united(atoms, bonds, near.select(*keys, F.col("id1").alias("a"), F.col("id2").alias("b")), keys)


def parallel_pairs(atoms: DataFrame, bonds: DataFrame, drawings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, short, long, gap, average: bonds that run beside a longer one (of equally long ones that with the smaller number) within half the average bond."""
    c = F.col
    line = cut(graph.bond_lengths(atoms, bonds, keys).join(drawings.select(*keys, "average"), keys).select(*keys, "bond_idx", "x1", "y1", "x2", "y2", F.round("length", 6).alias("length"), "average"))
    unit = lambda v: v / c("average")
    middle = line.select(*keys, c("bond_idx").alias("id"), unit((c("x1") + c("x2")) / 2).alias("x"), unit((c("y1") + c("y2")) / 2).alias("y"))
    met = spatial.near_segments(middle, line.select(*keys, c("bond_idx").alias("id"), *[unit(c(n)).alias(n) for n in ("x1", "y1", "x2", "y2")]), 0.5, keys).where("id1 <> id2")
    named = lambda p, name: line.select(*keys, c("bond_idx").alias(name), *[c(n).alias(f"{p}_{n}") for n in ("x1", "y1", "x2", "y2", "length")])
    both = met.select(*keys, c("id1").alias("short"), c("id2").alias("long")).join(named("s", "short"), [*keys, "short"]).join(named("l", "long"), [*keys, "long"])
    s, t = ([c(f"{p}_{n}") for n in ("x1", "y1", "x2", "y2")] for p in "sl")
    longer = F.struct(c("l_length"), -c("long")) > F.struct(c("s_length"), -c("short"))
    one, two = (F.abs(offset_from_line(*t, s[k], s[k + 1])) for k in (0, 2))
    beside = both.where(longer & (F.abs(cos_between(*s, *t)) > 0.95) & (F.abs(one - two) < 4)).withColumn("gap", F.round(F.greatest(one, two), 6))
    return beside.select(*keys, "short", "long", "gap").join(drawings.select(*keys, "average"), keys)


def double_gaps(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reach: below it parallel bonds are one of higher order: a little beyond the gap where the widest break begins among those of a drawing and half the average."""
    c = F.col
    rising = Window.partitionBy(*keys).orderBy("gap")
    steps = pairs.where(c("gap") < c("average") / 2).select(*keys, "gap", "average").distinct().withColumn("step", F.coalesce(F.lead("gap").over(rising), c("average") / 2) - c("gap"))
    best = steps.groupBy(*keys, "average").agg(F.max(F.struct("step", "gap")).alias("b"))
    return best.select(*keys, (c("b.gap") + F.least(c("b.step") / 2, c("average") / 16)).alias("reach"))


def parallel_merged(atoms: DataFrame, bonds: DataFrame, drawings: DataFrame, keys: list[str]) -> DataFrame:
    """bonds with those beside each other as one: the longest stays, its type the sum of all, 4 at most, aromatic if one is."""
    c = F.col
    pairs = cut(parallel_pairs(atoms, bonds, drawings, keys))
    near = pairs.join(double_gaps(pairs, keys), keys).where("gap < reach").select(*keys, c("short").alias("a"), c("long").alias("b"))
    part = cut(graph.components(near, keys).select(*keys, c("node").alias("bond_idx"), "component"))
    size = graph.bond_lengths(atoms, bonds, keys).select(*keys, "bond_idx", F.round("length", 6).alias("length"))
    own = bonds.join(part, [*keys, "bond_idx"]).join(size, [*keys, "bond_idx"])
    whole = own.groupBy(*keys, "component").agg(F.max_by("bond_idx", F.struct("length", -c("bond_idx"))).alias("bond_idx"), F.least(F.sum("type"), F.lit(4)).cast("int").alias("sum"), F.bool_or("arom").alias("any"))
    kept = bonds.join(whole.drop("component"), [*keys, "bond_idx"], "left").join(part.select(*keys, "bond_idx", F.lit(True).alias("in_group")), [*keys, "bond_idx"], "left")
    kept = kept.where(c("in_group").isNull() | c("sum").isNotNull())
    return cut(kept.withColumn("type", F.coalesce("sum", "type")).withColumn("arom", F.coalesce("any", "arom")).select(*bonds.columns))


def split_at_joints(atoms: DataFrame, bonds: DataFrame, reach: float, keys: list[str]) -> DataFrame:
    """bonds cut at atoms of other bonds that lie nearer than `reach` to them, and farther than that from their ends, numbered anew in their order."""
    c = F.col
    atoms, bonds = cut(atoms), cut(bonds)  # read three times and twice
    line = graph.bond_lengths(atoms, bonds, keys).select(*keys, c("bond_idx").alias("id"), "x1", "y1", "x2", "y2", "a", "b", "length")
    on = graph.connected_atoms(atoms, bonds, keys).select(*keys, c("atom_idx").alias("id"), "x", "y")
    met = spatial.near_segments(on, line, reach, keys, ["a", "b", "length"]).withColumnsRenamed({"id1": "atom_idx", "id2": "bond_idx"})
    met = met.where("atom_idx <> a and atom_idx <> b").where((c("along") > reach) & (c("along") < c("length") - reach))
    joints = met.groupBy(*keys, "bond_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("along", "atom_idx"))), lambda j: j["atom_idx"]).alias("joints"))  # few on a bond
    ends = F.concat(F.array("a"), F.coalesce("joints", F.array().cast("array<int>")), F.array("b"))
    rest = [n for n in bonds.columns if n not in ("a", "b", "bond_idx", *keys)]
    cut_up = bonds.join(joints, [*keys, "bond_idx"], "left").select(*keys, "bond_idx", *rest, F.posexplode(F.arrays_zip(F.slice(ends, 1, F.size(ends) - 1).alias("a"), F.slice(ends, 2, F.size(ends) - 1).alias("b"))).alias("k", "e"))
    order = Window.partitionBy(*keys).orderBy("bond_idx", "k")
    return cut(cut_up.select(*keys, (F.row_number().over(order) - 1).cast("int").alias("bond_idx"), c("e.a").alias("a"), c("e.b").alias("b"), *rest))


def free_ends(atoms: DataFrame, bonds: DataFrame, drawings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, atom_idx, x, y, far, far_x, far_y, hash, average: unlabelled atoms on one bond, with that bond's other atom."""
    c = F.col
    ways = bonds.select(*keys, F.explode(F.array(F.struct(c("a").alias("atom_idx"), c("b").alias("far")), F.struct(c("b").alias("atom_idx"), c("a").alias("far")))).alias("w"), "hash").select(*keys, "w.*", "hash")
    one = ways.groupBy(*keys, "atom_idx").agg(F.count("*").alias("n"), F.first("far").alias("far"), F.first("hash").alias("hash")).where("n = 1").drop("n")
    own = atoms.where(_blank("label")).select(*keys, "atom_idx", "x", "y").join(one, [*keys, "atom_idx"])
    return own.join(_at(atoms, keys, "far", "far_x", "far_y"), [*keys, "far"]).join(drawings.select(*keys, "average"), keys)


def ends_joined(atoms: DataFrame, bonds: DataFrame, drawings: DataFrame, reach: float, hash_reach: float, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) with each free end united with the nearest other atom that lies farther along its bond and nearer than `reach` average bonds; for a hash
    bond, whose dashes do not reach its atoms, `hash_reach`.
    """
    c = F.col
    free = cut(free_ends(atoms, bonds, drawings, keys))
    unit = lambda d, name: d.select(*keys, c(name).alias("id"), (c("x") / c("average")).alias("x"), (c("y") / c("average")).alias("y"))
    near = spatial.near_pairs(unit(free, "atom_idx"), unit(atoms.join(drawings.select(*keys, "average"), keys), "atom_idx"), max(reach, hash_reach), distance, keys).where("id1 <> id2")
    met = near.join(free.withColumnRenamed("atom_idx", "id1"), [*keys, "id1"]).join(_at(atoms, keys, "id2", "ox", "oy"), [*keys, "id2"]).where(c("id2") != c("far"))
    ahead = met.where(distance(c("far_x"), c("far_y"), c("ox"), c("oy")) > distance(c("far_x"), c("far_y"), c("x"), c("y"))).where(c("d") < F.when(c("hash"), hash_reach).otherwise(reach))
    best = ahead.groupBy(*keys, "id1").agg(F.min(F.struct(F.round("d", 9).alias("d"), "id2")).alias("m"))
    return united(atoms, bonds, best.select(*keys, c("id1").alias("a"), c("m.id2").alias("b")), keys)


def labels_attached(atoms: DataFrame, bonds: DataFrame, drawings: DataFrame, labels: DataFrame, reach: float, keys: list[str]) -> DataFrame:
    """atoms with each free end moved to the nearest of labels (keys, label_idx, a, x1, y1) ahead of it and nearer than `reach` average bonds, and named by it."""
    c = F.col
    free = cut(free_ends(atoms, bonds, drawings, keys))
    unit = lambda d, name, x, y: d.select(*keys, c(name).alias("id"), (c(x) / c("average")).alias("x"), (c(y) / c("average")).alias("y"))
    known = labels.join(drawings.select(*keys, "average"), keys)
    near = spatial.near_pairs(unit(free, "atom_idx", "x", "y"), unit(known, "label_idx", "x1", "y1"), reach, distance, keys)
    met = near.join(free.withColumnRenamed("atom_idx", "id1"), [*keys, "id1"]).join(labels.select(*keys, c("label_idx").alias("id2"), c("x1").alias("lx"), c("y1").alias("ly"), c("a").alias("text")), [*keys, "id2"])
    ahead = met.where(cos_between(c("far_x"), c("far_y"), c("x"), c("y"), c("far_x"), c("far_y"), c("lx"), c("ly")) > 0.85)
    best = ahead.groupBy(*keys, c("id1").alias("atom_idx")).agg(F.min(F.struct(F.round("d", 9).alias("d"), "id2", "lx", "ly", "text")).alias("m"))
    moved = atoms.join(best, [*keys, "atom_idx"], "left")
    return cut(moved.select(*keys, "atom_idx", F.coalesce("m.lx", "x").alias("x"), F.coalesce("m.ly", "y").alias("y"), F.coalesce("m.text", "label").alias("label")))


def round_rings(atoms: DataFrame, bonds: DataFrame, drawings: DataFrame, circles: DataFrame, keys: list[str]) -> DataFrame:
    """bonds, aromatic where they run round one of circles (keys, x, y, diameter) of a plausible size."""
    c = F.col
    line = graph.bond_lengths(atoms, bonds, keys).select(*keys, "bond_idx", "x1", "y1", "x2", "y2")
    met = line.join(circles, keys).join(drawings.select(*keys, "average"), keys)  # a drawing has few circles
    ends = [distance(c("x"), c("y"), c(f"x{k}"), c(f"y{k}")) for k in (1, 2)]
    middle = distance(c("x"), c("y"), (c("x1") + c("x2")) / 2, (c("y1") + c("y2")) / 2)
    fits = c("diameter").between(c("average") / 2, 3 * c("average")) & (F.greatest(*ends) < c("diameter") / 2 + c("average")) & (middle > c("diameter") / 2) & (F.abs(ends[0] - ends[1]) < c("average") / 3)
    hit = met.where(fits).select(*keys, "bond_idx").distinct().withColumn("_round", F.lit(True))
    return bonds.join(hit, [*keys, "bond_idx"], "left").withColumn("arom", c("arom") | F.coalesce("_round", F.lit(False))).drop("_round").select(*bonds.columns)


def wedges(atoms: DataFrame, bonds: DataFrame, drawings: DataFrame, samples: DataFrame, keys: list[str], least: float = 3.0, share: float = 1 / 12) -> DataFrame:
    """bonds, wedge where the line's width grows along them by more than `least` and `share` of the average bond, the narrow end first.

    samples: keys, id, x, y, w: widths measured along traced lines. Those beside a single bond, a twentieth of it from its ends, give the slope of a
    least-squares line; five of them at the least.
    """
    c = F.col
    line = graph.bond_lengths(atoms, bonds.where("type = 1 and not hash"), keys)
    met = spatial.near_segments(samples.select(*keys, "id", "x", "y"), line.select(*keys, c("bond_idx").alias("id"), "x1", "y1", "x2", "y2"), 2.5, keys)
    met = met.select(*keys, c("id1").alias("id"), c("id2").alias("bond_idx"), "along").join(samples.select(*keys, "id", "w"), [*keys, "id"]).join(line.select(*keys, "bond_idx", "length"), [*keys, "bond_idx"])
    inner = met.where(c("along").between(c("length") / 20, c("length") * 19 / 20))
    grown = inner.groupBy(*keys, "bond_idx", "length").agg(F.count("*").alias("n"), stats.slope("w", "along").alias("slope")).where("n >= 5").withColumn("grows", c("slope") * c("length"))
    grown = grown.join(drawings.select(*keys, "average"), keys).where(F.abs("grows") > F.greatest(F.lit(least), c("average") * share)).select(*keys, "bond_idx", "grows")
    out = bonds.join(grown, [*keys, "bond_idx"], "left")
    ends = [F.when(c("grows") < 0, c(b)).otherwise(c(a)).alias(a) for a, b in (("a", "b"), ("b", "a"))]
    return cut(out.select(*keys, "bond_idx", *ends, "type", "hash", (c("wedge") | c("grows").isNotNull()).alias("wedge"), "arom"))


def forks_trimmed(atoms: DataFrame, bonds: DataFrame, drawings: DataFrame, reach: float, keys: list[str]) -> DataFrame:
    """bonds without the free plain ends shorter than `reach` average bonds at the wide end of a wedge, which is traced as a fork."""
    c = F.col
    wide = bonds.where("wedge and not hash").select(*keys, c("b").alias("far")).distinct()
    size = graph.bond_lengths(atoms, bonds.where("type = 1 and not wedge and not hash"), keys).select(*keys, "bond_idx", "a", "b", "length")
    free = free_ends(atoms, bonds, drawings, keys).join(wide, [*keys, "far"], "left_semi").select(*keys, "atom_idx", "average")
    short = size.select(*keys, "bond_idx", "length", F.explode(F.array("a", "b")).alias("atom_idx")).join(free, [*keys, "atom_idx"]).where(c("length") < reach * c("average"))
    return bonds.join(short.select(*keys, "bond_idx"), [*keys, "bond_idx"], "left_anti")
