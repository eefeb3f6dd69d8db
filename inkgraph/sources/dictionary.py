"""Dictionaries: text files of `key value` lines, as DataFrames of key and value."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim


def parse_lines(lines: DataFrame, line: str = "line", order: str = "n") -> DataFrame:
    """key, value, order: empty lines, lines that start with # and lines without a blank are left out.

    Tabs are blanks; a line is split at its first blank and both parts are trimmed.
    """
    flat = F.translate(F.regexp_replace(line, "\r$", ""), "\t", " ")
    at = F.instr(flat, " ")
    used = lines.where((F.length(line) > 0) & ~F.startswith(F.col(line), F.lit("#"))).where(at > 0)
    return used.select(trim(F.substring(flat, F.lit(1), at - 1)).alias("key"), trim(F.substring(flat, at + 1, F.length(flat))).alias("value"), order)


def last_wins(pairs: DataFrame, key: str = "key", value: str = "value", order: str = "n") -> DataFrame:
    """key, value: of rows with one key the value of the last in order (of equal places the largest value)."""
    return pairs.groupBy(key).agg(F.max(F.struct(order, value)).alias("last")).select(key, F.col(f"last.{value}").alias(value))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a dictionary file; of repeated keys the last line wins."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\n", -1)).alias("n", "line"))
    return last_wins(parse_lines(lines))


def find_dictionary(name: str, given: str | None = None, folders: Iterable[str] = ()) -> str:
    """The first that exists of the given path and `name` in the folders; FileNotFoundError if none does."""
    for path in [given] if given else [os.path.join(f, name) for f in folders]:
        if os.path.exists(path):
            return path
    raise FileNotFoundError(f"dictionary {given or name}")
