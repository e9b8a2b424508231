"""Running totals, positions and extremes in an order, without one task per key: rows are put into bands of the order first.

Splitters are approximate quantiles, a fixed number per key, so a band holds a bounded share of a key's rows; windows run inside a
band, and what the bands before it hold is added from a table with one row per band. Which band a row falls into never
changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BANDS = 64
ACCURACY = 2000
_KEY = "_all"


def banded(df: DataFrame, keys: list[str], order: str, bands: int = BANDS) -> DataFrame:
    """df with ``_band``, growing with the order; nulls stand in the first band."""
    cuts = F.percentile_approx(order, [i / bands for i in range(1, bands)], ACCURACY).alias("_cuts")
    splits = df.groupBy(*keys).agg(cuts)
    if keys:
        met = df.alias("r").join(splits.select(*(F.col(k).alias(f"_{k}") for k in keys), "_cuts"), _same(df, keys), "left")
    else:
        met = df.join(F.broadcast(splits), F.lit(True), "left")  # one row
    at = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(order))), F.lit(0))
    return met.withColumn("_band", at).drop("_cuts", *(f"_{k}" for k in keys))


def _same(df: DataFrame, keys: list[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"r.{k}").eqNullSafe(F.col(f"_{k}"))
    return test


def _before(bands: DataFrame, keys: list[str], total: Column, name: str) -> DataFrame:
    """Per band what all bands before it hold; a key has at most ``BANDS`` rows here."""
    order = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    return bands.withColumn(name, total.over(order)).select(*keys, "_band", name)


def _joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    renamed = other.select(*(F.col(k).alias(f"_{k}") for k in [*keys, "_band"]), *(c for c in other.columns if c not in (*keys, "_band")))
    return df.alias("r").join(renamed, _same(df, [*keys, "_band"]), "left").drop(*(f"_{k}" for k in [*keys, "_band"]))


def running_total(df: DataFrame, keys: list[str], order: str, amount: str, name: str) -> DataFrame:
    """df with the total of ``amount`` over the rows of the key up to and with this one; ``order`` must be unique in a key."""
    rows = banded(df, keys, order)
    before = _before(rows.groupBy(*keys, "_band").agg(F.sum(amount).alias("_sum")), keys, F.sum("_sum"), "_before")
    inside = Window.partitionBy(*keys, "_band").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("_within", F.sum(amount).over(inside))
    return _joined(within, before, keys).withColumn(name, F.col("_within") + F.coalesce("_before", F.lit(0))).drop("_within", "_before", "_band")


def positions(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """df with the place of each row of the key in the order, from 1; ``order`` should be unique in a key."""
    return running_total(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, "_one", name).drop("_one")


def above_all_before(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """Rows whose value is above that of every row before them in the order."""
    rows = banded(df, [], order[0])
    before = _before(rows.groupBy("_band").agg(F.max(value).alias("_max")), [], F.max("_max"), "_before")
    kept = _joined(rows, before, []).where(F.col("_before").isNull() | (F.col(value) > F.col("_before")))
    inside = Window.partitionBy("_band").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("_most", F.max(value).over(inside)).where(F.col("_most").isNull() | (F.col("_most") < F.col(value))).drop("_band", "_before", "_most")
