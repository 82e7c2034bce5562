"""Column expressions on ``array<double>`` vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def distance(a: Column, b: Column) -> Column:
    return norm(subtract(a, b))


def row_normalised(a: Column) -> Column:
    """a / sum(a), a itself where the sum is 0."""
    s = total(a)
    return F.transform(a, lambda x: x / F.when(s == 0, F.lit(1.0)).otherwise(s))


def log_feature(c: Column) -> Column:
    """log(1 + max(x, 0)) with null as 0."""
    return F.log1p(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)))
