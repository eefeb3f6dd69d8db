"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for a row, also where `use` needs it inside another lambda.

    A plain column may be inlined where it is used, and is then computed again for each element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
