"""Two-valued predicates: a comparison with a missing side is false, and so `negated` of it is true."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def gt(a: Column, b: Column) -> Column:
    return sure(a > b)


def lt(a: Column, b: Column) -> Column:
    return sure(a < b)


def gte(a: Column, b: Column) -> Column:
    return sure(a >= b)


def lte(a: Column, b: Column) -> Column:
    return sure(a <= b)


def between(a: Column, b: Column, c: Column) -> Column:
    """Inclusive, with the bounds in either order."""
    return sure(b.isNotNull() & c.isNotNull() & a.between(F.least(b, c), F.greatest(b, c)))


def cross_above(a: Column, b: Column, order: WindowSpec) -> Column:
    return sure((F.lag(a).over(order) <= F.lag(b).over(order)) & (a > b))


def cross_below(a: Column, b: Column, order: WindowSpec) -> Column:
    return sure((F.lag(a).over(order) >= F.lag(b).over(order)) & (a < b))


def every(*conditions: Column) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def either(*conditions: Column) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def negated(condition: Column) -> Column:
    return ~condition
