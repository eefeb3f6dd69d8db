"""Plane geometry as column expressions; y grows downwards, as in images.

Undefined quotients (segments of no length) are null, so comparisons with them fail as they do with NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """As a root of squares, which IEEE rounds alike everywhere; hypot's last bit varies, and what lies just at a segment's end hangs on it."""
    w, h = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    return F.sqrt(w * w + h * h)


def chebyshev(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.abs(x1 - x2), F.abs(y1 - y2))


def cos_between(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    """Cosine of the angle from segment 1-2 to segment 3-4."""
    dot = (x2 - x1) * (x4 - x3) + (y2 - y1) * (y4 - y3)
    return F.try_divide(dot, distance(x1, y1, x2, y2) * distance(x3, y3, x4, y4))


def cos_at(ax, ay, bx, by, cx, cy) -> Column:
    """Cosine of the angle a-b-c at b."""
    return cos_between(bx, by, ax, ay, bx, by, cx, cy)


def offset_from_line(x0, y0, x1, y1, x, y) -> Column:
    """Signed distance of (x, y) from the line 0-1, positive to its left as seen with y down."""
    return F.try_divide((y1 - y0) * (x - x0) - (x1 - x0) * (y - y0), distance(x0, y0, x1, y1))


def along_line(x0, y0, x1, y1, x, y) -> Column:
    """Where (x, y) projects on the line 0-1, as a length from end 0."""
    return F.try_divide((x1 - x0) * (x - x0) + (y1 - y0) * (y - y0), distance(x0, y0, x1, y1))


def beyond_line(x0, y0, x1, y1, x, y) -> Column:
    """Where (x, y) projects on the line 0-1, as a length from end 1."""
    return F.try_divide((x1 - x0) * (x - x1) + (y1 - y0) * (y - y1), distance(x0, y0, x1, y1))


def gap_between(a: tuple, b: tuple, tolerance: float = 4.0) -> Column:
    """Largest distance of segment b's ends from the line of a, null unless the two differ by less than `tolerance`.

    a and b are (x1, y1, x2, y2).
    """
    first, second = (F.abs(offset_from_line(*a, b[k], b[k + 1])) for k in (0, 2))
    return F.when(F.abs(first - second) < tolerance, F.greatest(first, second))


def point_box_distance(x, y, x1, y1, x2, y2) -> Column:
    """0 inside the box."""
    zero = F.lit(0.0)
    return F.hypot(F.greatest(x1 - x, zero, x - x2), F.greatest(y1 - y, zero, y - y2))


def box_box_distance(a: tuple, b: tuple) -> Column:
    """Least distance from a corner of one box (x1, y1, x2, y2) to the other box."""
    corners = lambda b: [(b[i], b[j]) for i in (0, 2) for j in (1, 3)]
    return F.least(*[point_box_distance(*c, *b) for c in corners(a)], *[point_box_distance(*c, *a) for c in corners(b)])


def rotate(x, y, mid_x, mid_y, radians) -> tuple[Column, Column]:
    """A point turned about a centre."""
    dx, dy, c, s = x - mid_x, y - mid_y, F.cos(radians), F.sin(radians)
    return mid_x + dx * c - dy * s, mid_y + dx * s + dy * c


def rotated_box(box: tuple, width, height, radians) -> list[Column]:
    """Bounding box of a box turned about the middle of a page."""
    corners = [rotate(box[i], box[j], width / 2, height / 2, radians) for i in (0, 2) for j in (1, 3)]
    return [F.least(*[c[0] for c in corners]), F.least(*[c[1] for c in corners]), F.greatest(*[c[0] for c in corners]), F.greatest(*[c[1] for c in corners])]


def area_ratio(a: Column, b: Column) -> Column:
    """The larger divided by the smaller, as whole numbers."""
    return F.try_divide(F.greatest(a, b), F.least(a, b)).cast("long")


def midpoint(x1, y1, x2, y2) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def overlap_ratio(a: tuple, b: tuple) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 if they do not meet."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    return F.try_divide((w * h).cast("double"), area(a) + area(b) - w * h)


def next_in_ring(i: Column, n: Column) -> Column:
    """The cyclic successor of an index."""
    return F.pmod(i + 1, n)


def lengthened(x1, y1, x2, y2, parts: Column) -> tuple[Column, Column, Column, Column]:
    """A segment made longer at both ends by its length over (parts - 1), as a row of dashes needs it."""
    dx, dy = F.try_divide(x2 - x1, parts - 1), F.try_divide(y2 - y1, parts - 1)
    return x1 - dx, y1 - dy, x2 + dx, y2 + dy
