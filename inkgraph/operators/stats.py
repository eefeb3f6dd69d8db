"""Order statistics, histograms and the searches on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_index(value: Column, index: Column) -> Column:
    """The value at an index, from 0, of the sorted values of a group."""
    return F.element_at(F.sort_array(F.collect_list(value)), index.cast("int") + 1)


def percentile75(value: str) -> Column:
    """Sorted value at 3 (n - 1) div 4; 10 if there are fewer than two."""
    n = F.count(value)
    return F.when(n > 1, order_index(F.col(value), F.expr(f"3 * (count({value}) - 1) div 4"))).otherwise(10.0)


def lower_median(value: str) -> Column:
    """Sorted value at (n - 1) div 2; exact, and it aggregates by distinct value before the shuffle."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})")


def ordered_values(rows: DataFrame, keys: list[str], value: str, index: str, out: str) -> DataFrame:
    """keys, out: the value at a place of each group's sorted values; `index` is SQL over n, the group's size, and counts from 0.

    For groups of any size: rows are counted by distinct value before the shuffle, and only these counts are sorted.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias(out)).agg(F.count("*").alias("_count"))
    part = Window.partitionBy(*keys)
    upto = part.orderBy(out).rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("n", F.sum("_count").over(part)).withColumn("_upto", F.sum("_count").over(upto))
    return c.where(F.col("_upto") > F.expr(index)).groupBy(*keys).agg(F.min(out).alias(out))


def histogram(rows: DataFrame, value: Column, bins: int, width: float, keys: list[str] = ()) -> DataFrame:
    """keys, bin, n for all bins from 0, also the empty ones."""
    bin_ = F.least(F.greatest(F.floor(value / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))
    if keys:
        dense = counts.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        return dense.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    dense = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return dense.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def otsu(hist: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, split, peak1, peak2, max1, max2: the best split of a histogram (bin, n) and the tallest bin on either side.

    The split maximises w (1 - w) (difference of means)^2, the first wins; a side without weight is no split. The bins up to the
    split are the first side. One row a bin: a histogram is small, whatever it counts.
    """
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("total", F.sum("n").over(part)).withColumn("moment", F.sum(F.col("bin") * F.col("n")).over(part))
    h = h.withColumn("w", F.sum("n").over(upto)).withColumn("m", F.sum(F.col("bin") * F.col("n")).over(upto))
    share = F.try_divide(F.col("w").cast("double"), F.col("total"))
    between = F.try_divide(F.col("m").cast("double"), F.col("w")) - F.try_divide((F.col("moment") - F.col("m")).cast("double"), F.col("total") - F.col("w"))
    h = h.withColumn("sigma", F.round(share * (1 - share) * between * between, 9))
    best = F.max(F.when(F.col("sigma").isNotNull(), F.struct("sigma", (-F.col("bin")).alias("early")))).over(part)
    h = h.withColumn("split", -best["early"])
    side = lambda low: F.max(F.when((F.col("bin") <= F.col("split")) == low, F.struct("n", (-F.col("bin")).alias("early"))))
    out = h.where("split is not null").groupBy(*keys, "split").agg(side(True).alias("a"), side(False).alias("b"))
    return out.select(*keys, "split", (-F.col("a.early")).alias("peak1"), (-F.col("b.early")).alias("peak2"), F.col("a.n").alias("max1"), F.col("b.n").alias("max2"))


def first_local_min(hist: DataFrame, start: int = 3, default: int = 1) -> DataFrame:
    """bin: the first local maximum from `start` on, then the first local minimum after it; `default` if there is none.

    The last bin is neither.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    h = hist.select("bin", "n", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after"))
    top = h.where((F.col("bin") >= start) & (F.col("n") > F.col("before")) & (F.col("n") > F.col("after"))).agg(F.min("bin").alias("top"))
    low = h.join(F.broadcast(top), F.col("bin") > F.col("top")).where((F.col("n") < F.col("before")) & (F.col("n") < F.col("after")))
    return low.agg(F.coalesce(F.min("bin"), F.lit(default)).alias("bin"))


def empty_share_entropy(cells: DataFrame, row: str, column: str, columns: int) -> DataFrame:
    """row, empty, entropy: for each row of a grid the share p of its cells that no (row, column) hits, and -p ln p."""
    used = cells.groupBy(row).agg(F.countDistinct(column).alias("used"))
    p = (F.lit(columns) - F.col("used")) / F.lit(float(columns))
    return used.select(row, p.alias("empty"), F.when(p > 0, -p * F.ln(p)).otherwise(0.0).alias("entropy"))


def max_entropy(rows: DataFrame, row: str) -> DataFrame:
    """The row of largest entropy, the first on a tie."""
    top = F.max(F.struct(F.round("entropy", 9).alias("entropy"), (-F.col(row)).alias("early"))).alias("top")
    return rows.agg(top).select((-F.col("top.early")).alias(row), F.col("top.entropy").alias("entropy"))


def run_lengths(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, value, length: maximal runs of equal values in order."""
    a = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    b = F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order))
    return rows.withColumn("island", a - b).groupBy(*keys, value, "island").agg(F.count("*").alias("length")).drop("island")


def noise_factors(hist: DataFrame, size: str = "length", n: str = "n") -> DataFrame:
    """thickness, factor, factor45 from a histogram of run lengths.

    thickness is the most common length from 1 to 39 (the first on a tie). factor is n2/n3 if it is over 2, n1/n2 if it is 2 and n2/n1
    if it is 1; factor45 is n4/n5, or 0 if there is no n5.
    """
    h = hist.where(F.col(size).between(1, 39))
    count = lambda k: F.coalesce(F.sum(F.when(F.col(size) == k, F.col(n))), F.lit(0)).cast("double")
    got = h.agg(F.max(F.struct(F.col(n), (-F.col(size)).alias("early"))).alias("top"), *[count(k).alias(f"n{k}") for k in range(1, 6)])
    thick = -F.col("top.early")
    factor = F.when(thick > 2, F.try_divide("n2", "n3")).when(thick == 2, F.try_divide("n1", "n2")).otherwise(F.try_divide("n2", "n1"))
    return got.select(thick.alias("thickness"), factor.alias("factor"), F.coalesce(F.try_divide("n4", "n5"), F.lit(0.0)).alias("factor45"))


def polar_bin(x: Column, y: Column, bins: int = 50) -> Column:
    """Which of `bins` equal sectors the direction (x, y) lies in, counted from -pi."""
    turn = (F.atan2(y, x) + math.pi) / (2 * math.pi) * bins
    return F.pmod(F.floor(turn).cast("int"), F.lit(bins))


def slope(y: str, x: str) -> Column:
    return F.regr_slope(F.col(y), F.col(x))


def closest_gap(gaps: Column, average: Column) -> Column:
    """The distance under which parallel lines are one bond, from the sorted gaps of a molecule (an array).

    The gap at 3 (n - 1) div 4: a third of the average length if it is under 1, else plus 2, and taken further while the
    next gap is within 1; 0.001 is added.
    """
    at = F.expr("1")
    sorted_ = F.sort_array(gaps)
    base = F.element_at(sorted_, F.greatest(at, (F.floor((F.size(sorted_) - 1) * 0.75)).cast("int") + 1))
    grown = F.aggregate(sorted_, base + 2.0, lambda m, g: F.when((g > m) & (g <= m + 1), g).otherwise(m))
    return F.when(F.size(sorted_) == 0, average / 3).when(base < 1, average / 3).otherwise(grown) + 0.001
