"""Selection of records: best resolution of each document, best record, filters.

Arg-max is a maximum of a struct: it aggregates before the shuffle and needs no sort of a document's records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Resolutions tried when none is asked for: iteration, dots per inch, thinning.
RESOLUTIONS = [(0, 72, True), (1, 150, True), (2, 300, True), (3, 300, False), (4, 500, True)]
FONT_WIDTH, FONT_HEIGHT = 21, 22
MIN_ATOMS, MAX_ATOMS = 5, 250


def resolutions(spark: SparkSession, asked: int = 0) -> DataFrame:
    """res_iter, dpi, thin: all five, or the one asked for."""
    return spark.createDataFrame(RESOLUTIONS if asked == 0 else [(0, asked, True)], "res_iter int, dpi int, thin boolean")


def dpi_of(res_iter: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r[1]) for r in RESOLUTIONS]), res_iter.cast("int") + 1)


def threshold(given: Column, dpi: Column) -> Column:
    """Bond threshold: as given, or by resolution if 0."""
    return F.when(given != 0, given).when(dpi >= 150, 0.4).otherwise(0.2)


def best_resolution(records: DataFrame, doc: str = "doc_id", res: str = "res_iter", dpi: str = "dpi", confidence: str = "confidence", places: int = 9) -> DataFrame:
    """doc, res, mean: for each document the resolution with the largest mean confidence over all its pages.

    A tie goes to a resolution of 300 dpi, then to the earliest. Means are rounded to `places`, so they do not depend on order.
    """
    mean = F.round(F.try_divide(F.sum(confidence), F.count(F.lit(1))), places)
    each = records.groupBy(doc, res).agg(mean.alias("mean"), F.max(F.col(dpi) == 300).alias("usual"))
    top = F.max(F.struct("mean", "usual", (-F.col(res)).alias("early"))).alias("top")
    return each.groupBy(doc).agg(top).select(doc, (-F.col("top.early")).alias(res), F.col("top.mean").alias("mean"))


def select_resolution(records: DataFrame, doc: str = "doc_id", res: str = "res_iter", **names) -> DataFrame:
    """The records of each document's best resolution."""
    return records.join(best_resolution(records, doc, res, **names).drop("mean"), [doc, res], "left_semi")


def learning_listing(records: DataFrame, doc: str, order: list[Column], name: str = "ord") -> DataFrame:
    """All records of all resolutions, numbered within their document."""
    return records.withColumn(name, F.row_number().over(Window.partitionBy(doc).orderBy(*order)))


def best_record(records: DataFrame, keys: list[str], confidence: str, ties: list[str]) -> DataFrame:
    """One record for each key (for the whole table without keys): the most confident, ties by the smallest of `ties` in order.

    An empty table gives no record.
    """
    top = F.max(F.struct(F.col(confidence), *[(-F.col(t)).alias(t) for t in ties])).alias("top")
    found = records.groupBy(*keys).agg(top).where("top is not null")
    return found.select(*keys, F.col(f"top.{confidence}"), *[(-F.col(f"top.{t}")).alias(t) for t in ties])


def large_boxes(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes larger than a glyph both ways and more than twice as large in one."""
    return boxes.where((width > FONT_WIDTH) & (height > FONT_HEIGHT) & ((width > 2 * FONT_WIDTH) | (height > 2 * FONT_HEIGHT)))


def drawable(atoms: Column, bonds: Column, max_type: Column) -> Column:
    """Whether a graph is of a size and kind to make a structure of."""
    return (atoms > MIN_ATOMS) & (atoms < MAX_ATOMS) & (bonds > 0) & (bonds < MAX_ATOMS) & (max_type > 0) & (max_type < 5)


def worth_keeping(fragments: Column, atoms: Column, bonds: Column) -> Column:
    """Whether a finished record is kept."""
    return (fragments > 0) & (fragments < 10) & (atoms > MIN_ATOMS) & (bonds > 0)


def within_half(value: Column, best: Column) -> Column:
    """Average bond lengths from half of the best one to twice it; all if there is no best one."""
    return (best <= 0) | ((value > best / 2) & (value < best * 2))


def reading_order(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2", id: str = "id") -> list[Column]:
    """A total order of boxes: from the top, then from the left."""
    return [F.col(c) for c in (y1, x1, y2, x2, id)]


def confident_bond_length(records: DataFrame, confidence: str = "confidence", length: str = "avg_bond") -> DataFrame:
    """avg_bond of the most confident record of all."""
    return records.agg(F.max_by(F.col(length), F.struct(F.col(confidence), F.col(length))).alias(length))
