"""Array expressions that stay linear in the array's length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def _running(values: Column, base: Column) -> Column:
    start = F.array(base.cast("bigint"))
    return F.aggregate(
        values,
        start,
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.cast("bigint"))),
        lambda acc: F.slice(acc, F.lit(2), F.greatest(F.size(acc) - 1, F.lit(0))),
    )


def prefix_sums(values: Column) -> Column:
    """Running totals of an array of integers (a null or empty array: an empty array).

    An array is extended by copying, so a plain fold costs the square of the length. The array is cut into
    blocks; totals run over the blocks first and then inside each block.
    """
    zero = F.lit(0).cast("bigint")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(_BLOCK)).cast("int")),
        lambda i: F.slice(values, i * _BLOCK + 1, F.lit(_BLOCK)),
    )
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x.cast("bigint"))
    sums = F.transform(blocks, total)
    bases = F.zip_with(_running(sums, zero), sums, lambda after, own: after - own)
    several = F.flatten(F.zip_with(blocks, bases, _running))
    return (
        F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.array().cast("array<bigint>"))
        .when(F.size(values) <= _BLOCK, _running(values, zero))
        .otherwise(several)
    )
