"""Array arithmetic on vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """At least 0; 0 where a side has no length."""
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0)))


def normalized(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: F.when(length <= 1e-12, 0.0).otherwise(F.try_divide(x.cast("double"), length)))


def quantized(a: Column) -> Column:
    """Whole numbers from -127 to 127, halves away from zero, by the largest absolute value."""
    top = F.aggregate(a, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    scaled = lambda x: F.coalesce(F.try_divide(x.cast("double") * 127, top), F.lit(0.0))
    return F.transform(a, lambda x: (F.signum(scaled(x)) * F.floor(F.abs(scaled(x)) + 0.5)).cast("int"))
