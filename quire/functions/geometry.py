"""Geometry of boxes given as arrays [x1, y1, x2, y2]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sides(box: Column) -> tuple[Column, Column, Column, Column]:
    """x1, y1, x2, y2; zero where the box is missing or short."""
    return tuple(F.coalesce(F.try_element_at(box, F.lit(i)), F.lit(0.0)) for i in (1, 2, 3, 4))


def normalized(box: Column, width: Column, height: Column) -> Column:
    """A box in shares of the page; a page of no size counts as 1."""
    w, h = (F.when(F.coalesce(x, F.lit(0.0)) == 0, 1.0).otherwise(x) for x in (width, height))
    x1, y1, x2, y2 = sides(box)
    return F.array(x1 / w, y1 / h, x2 / w, y2 / h)


def area(box: Column) -> Column:
    """Area of a box."""
    x1, y1, x2, y2 = sides(box)
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def intersection_ratio(inner: Column, outer: Column) -> Column:
    """Share of the inner box that lies in the outer one."""
    a1, b1, a2, b2 = sides(inner)
    c1, d1, c2, d2 = sides(outer)
    both = F.greatest(F.least(a2, c2) - F.greatest(a1, c1), F.lit(0.0)) * F.greatest(F.least(b2, d2) - F.greatest(b1, d1), F.lit(0.0))
    return F.when(area(inner) > 0, both / area(inner)).otherwise(0.0)


def horizontal_overlap(left: Column, right: Column) -> Column:
    """Shared width over the narrower width."""
    a1, _, a2, _ = sides(left)
    b1, _, b2, _ = sides(right)
    narrow = F.least(a2 - a1, b2 - b1)
    return F.when(narrow > 0, F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0.0)) / narrow).otherwise(0.0)


def vertical_gap(upper: Column, lower: Column) -> Column:
    """Height between two boxes; 0 where they overlap."""
    _, a1, _, a2 = sides(upper)
    _, b1, _, b2 = sides(lower)
    return F.greatest(b1 - a2, a1 - b2, F.lit(0.0))
