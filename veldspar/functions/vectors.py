"""Vector arithmetic on array columns, as higher-order functions.

A null vector gives null. Vectors of different lengths give null as well, since ``zip_with`` pads the shorter with nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Column | str


def col(x: Vec) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def zip_total(x: Vec, y: Vec, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f over two vectors, without an array between."""
    return total(F.zip_with(col(x), col(y), f))


def dot(x: Vec, y: Vec) -> Column:
    return zip_total(x, y, lambda a, b: a * b)


def squared_distance(x: Vec, y: Vec) -> Column:
    return zip_total(x, y, lambda a, b: (a - b) * (a - b))


def norm(x: Vec) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Vec, y: Vec) -> Column:
    """Cosine, null where a vector is zero."""
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def scale(x: Vec, by: Column) -> Column:
    return F.transform(col(x), lambda v: v * by)


def normalised(x: Vec) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = norm(x)
    return F.when(n > 0, scale(x, 1 / n)).otherwise(col(x))


def doubles(x: Vec) -> Column:
    return F.transform(col(x), lambda v: v.cast("double"))


def finite(x: Vec, d: int | None = None) -> Column:
    """Whether a vector has (d) numbers, none null, NaN or infinite."""
    x = col(x)
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(ok & (F.size(x) == d if d else F.size(x) > 0), F.lit(False))
