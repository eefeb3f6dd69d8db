"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blank.
BLANK = " \n\t\u000b\r\f"
#: The characters that an optical reader may return, and those that count as recognised in a finished graph.
READABLE = "oOcCnNHFsSBuUgMeEXYZRPp23456789AmThD"
COUNTED = "oOcCNHsSBMeEXYZRPp23456789AF"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def readable_count(c: Column, alphabet: str = COUNTED) -> Column:
    """How many of the characters are in the alphabet."""
    return F.length(F.regexp_replace(c, f"[^{alphabet}]", ""))


def array_text(c: Column) -> Column:
    """`[a, b]`."""
    return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))


def output_line(structure: Column, *fields: Column) -> Column:
    """A structure and the fields asked for, in order, by single spaces; nulls are left out."""
    return F.concat_ws(" ", structure, *fields)


def box_text(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """`x1xy1-x2xy2`."""
    s = lambda c: c.cast("string")
    return F.concat(s(x1), F.lit("x"), s(y1), F.lit("-"), s(x2), F.lit("x"), s(y2))
