"""Corpus operators: several runs over one input are merged, filtered and made unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import cut
from . import spatial

#: What a run may vary: jaggy thinning or not, rounds of page clean-up, automatic resolution or 150.
GRID = {"jaggy": [False, True], "unpaper": [0, 1, 2], "resolution": [0, 150]}


def option_grid(spark: SparkSession, grid: dict[str, list] | None = None) -> DataFrame:
    """run_id and a column for each option: every combination."""
    out = spark.range(1)
    for name, values in (grid or GRID).items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    order = list(grid or GRID)
    return out.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("run_id"), *order)


def claim(records: DataFrame, keys: list[str], least: float = 0.9, differ: float = 0.1) -> DataFrame:
    """The records (keys, run_id, record_ord, x1, y1, x2, y2, confidence, ...) left after merging the runs of each page.

    In order of run and record, a record that is still free claims the free records of later runs that overlap it by more than `least`
    and differ by less than `differ` in width and height; the most confident of them, the first on a tie, stands for all.

    Rivals are found by grid cell. Whether a record is free hangs on its earlier rivals alone, so it is settled in the first round in which they are:
    claimed as soon as one of them is free, free itself once none is left. There are as many rounds as the longest chain of rivals has links.
    """
    c, keys, rest = F.col, list(keys), [n for n in records.columns if n not in keys]
    own = F.struct("run_id", "record_ord", *[n for n in rest if n not in ("run_id", "record_ord")])  # rows that repeat run and record are told apart by the rest
    all_ = records.withColumn("_id", own)
    boxes = all_.select(*keys, c("_id").alias("id"), "x1", "y1", "x2", "y2")
    met = spatial.overlapping(boxes, least, keys, differ=differ).where("id1.run_id < id2.run_id")
    pairs = cut(met.select(*keys, c("id1").alias("early"), c("id2").alias("late")))
    lates = pairs.select(*keys, "late").distinct()
    heads = fresh = cut(pairs.select(*keys, c("early").alias("head")).distinct().join(lates.withColumnRenamed("late", "head"), [*keys, "head"], "left_anti"))
    left, undecided = pairs, lates
    while fresh.head(1):
        gone = cut(left.join(fresh.withColumnRenamed("head", "early"), [*keys, "early"], "left_semi").select(*keys, "late").distinct())
        left = cut(left.join(gone, [*keys, "late"], "left_anti").join(gone.withColumnRenamed("late", "early"), [*keys, "early"], "left_anti"))
        undecided = undecided.join(gone, [*keys, "late"], "left_anti")
        fresh = cut(undecided.join(left.select(*keys, "late").distinct(), [*keys, "late"], "left_anti").select(*keys, c("late").alias("head")))
        undecided = cut(undecided.join(fresh.withColumnRenamed("head", "late"), [*keys, "late"], "left_anti"))
        heads = heads.unionByName(fresh)
    owner = pairs.join(heads.withColumnRenamed("head", "early"), [*keys, "early"], "left_semi").groupBy(*keys, c("late").alias("_id")).agg(F.min("early").alias("_head"))
    best = F.min(F.struct((-c("confidence")).alias("least"), "_id")).alias("best")
    chosen = all_.select(*keys, "_id", "confidence").join(owner, [*keys, "_id"], "left").groupBy(*keys, F.coalesce("_head", "_id").alias("_head")).agg(best)
    return chosen.select(*keys, *[c(f"best._id.{n}").alias(n) for n in rest]).select(*records.columns)


def first_rows(rows: DataFrame, take: int, order: list[Column]) -> DataFrame:
    """The first `take` rows in order, however many that are: no task holds more than a partition of the sort.

    Row numbers of a sorted table grow from partition to partition, so with the partitions' counts, a row each, the last row
    wanted has a known number.
    """
    numbered = cut(rows.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    counts = numbered.groupBy(F.shiftright("_row", 33).alias("part")).count().orderBy("part").collect()
    bound = 0
    for r in counts:
        bound = (r["part"] << 33) + min(take, r["count"])
        take -= min(take, r["count"])
        if take == 0:
            break
    return numbered.where(F.col("_row") < bound).drop("_row")


def bond_length_band(records: DataFrame, confidence: str, length: str, ties: list[str]) -> DataFrame:
    """Records whose bond length is within two sample deviations of the mean over the most confident ones.

    These are the first min(n, max(10, (n - 1) div 10) + 1) by confidence, then by ties; so the n rows are counted first.
    """
    n = records.count()
    take = min(n, max(10, (n - 1) // 10) + 1) if n else 0
    if take == 0:
        return records
    names = list(dict.fromkeys([confidence, length, *ties]))
    top = first_rows(records.select(*names), take, [F.col(confidence).desc(), *[F.col(t) for t in ties]])
    band = top.agg(F.round(F.avg(length), 9).alias("_mean"), F.round(F.stddev_samp(length), 9).alias("_dev"))
    joined = records.crossJoin(F.broadcast(band))  # one row
    return joined.where((F.col(length) > F.col("_mean") - 2 * F.col("_dev")) & (F.col(length) < F.col("_mean") + 2 * F.col("_dev"))).drop("_mean", "_dev")


def plausible(angle_min: Column, angle_max_c: Column, angle_exo: Column, bond_min: Column, heavy: Column, weight: Column, confidence: Column, unknown: Column, bad_stereo: Column, bad_valence: Column) -> Column:
    """Whether a molecule passes the property filter: its smallest bond and angles, size and confidence, with no unknown atom, no
    broken stereo and no impossible valence. A null measure (nothing to measure) passes.
    """
    ok = lambda c: F.coalesce(c, F.lit(True))
    return (
        (confidence > 0.4) & ~unknown & ok(bond_min > 0.85) & ok(angle_min > 10) & ok(angle_max_c < 155) & ok(angle_exo > 50) & (heavy > 6) & (weight < 2000) & ~bad_stereo & ~bad_valence
    )


def bond_angles(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, atom_idx, angle in degrees for each two bonds of an atom; lengths has bond_idx, a, b, x1, y1, x2, y2.

    An atom has few bonds, so its pairs are few.
    """
    out = lengths.select(*keys, "bond_idx", F.col("a").alias("atom_idx"), (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    back = lengths.select(*keys, "bond_idx", F.col("b").alias("atom_idx"), (F.col("x1") - F.col("x2")).alias("dx"), (F.col("y1") - F.col("y2")).alias("dy"))
    ends = out.unionByName(back)
    other = ends.select(*keys, "atom_idx", F.col("bond_idx").alias("_other"), F.col("dx").alias("ex"), F.col("dy").alias("ey"))
    pairs = ends.join(other, [*keys, "atom_idx"]).where("bond_idx < _other")
    cos = F.try_divide(F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey"), F.hypot("dx", "dy") * F.hypot("ex", "ey"))
    return pairs.select(*keys, "atom_idx", F.degrees(F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0)))).alias("angle"))


def unique_by_key(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first record of each key; records with an empty or null key all stay.

    A minimum of a struct aggregates before the shuffle, so a key that a third of all records share is no hot spot.
    """
    empty = F.coalesce(F.col(key), F.lit("")) == ""
    rest = [c for c in records.columns if c not in order]
    first = records.where(~empty).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return records.where(empty).select(*order, *rest).unionByName(first.select("first.*"))

