"""Statistics of scored pairs: ranks, correlations, ties, percentiles, gates, staircases and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import ordered


def average_rank(df: DataFrame, value: str, name: str, by: str | None = None) -> DataFrame:
    """Ranks from 1; equal values get the mean of their places.

    Distinct values are counted first, so the ordered pass has one row per value, in bands of the order.
    """
    keys = [by] if by else []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranks = ordered.running_total(counts, keys, value, "_c", "_upto").select(*keys, value, (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value])


def pearson(x: Column, y: Column) -> Column:
    """An aggregate: the correlation, 0 without rows, and where one side does not vary 1 if the sides are equal, else 0."""
    n, sx, sy = F.count(F.lit(1)).cast("double"), F.sum(x), F.sum(y)
    vx, vy = n * F.sum(x * x) - sx * sx, n * F.sum(y * y) - sy * sy
    flat = F.coalesce((F.var_pop(x) == 0) | (F.var_pop(y) == 0), F.lit(True))
    same = F.coalesce(F.bool_and(x == y), F.lit(False))
    return F.when(flat, F.when(same, 1.0).otherwise(0.0)).otherwise(F.try_divide(n * F.sum(x * y) - sx * sy, F.sqrt(vx * vy)))


def nearest_percentile(df: DataFrame, value: str, fractions: list[tuple[int, int]], by: str | None = None) -> DataFrame:
    """The value at the index nearest to last * num / den (halves up), found by counts rather than by collecting."""
    keys = [by] if by else []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    upto = ordered.running_total(counts, keys, value, "c", "upto")
    upto = upto.join(sizes, keys) if keys else upto.join(F.broadcast(sizes), F.lit(True))
    index = lambda num, den: F.floor(((F.col("n") - 1) * num + den // 2) / den)
    hit = lambda num, den: F.min(F.when(F.col("upto") > index(num, den), F.col(value)))
    return upto.groupBy(*keys).agg(*(hit(a, b).alias(f"p{100 * a // b}") for a, b in fractions))


def tie_counts(df: DataFrame, score: str, key: str) -> DataFrame:
    """Pairs of equal score, apart by whether the keys are equal: counts of counts in place of a self-join."""
    pairs = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1)), F.lit(0)) / 2
    by_key = df.groupBy(score, key).agg(F.count("*").alias("c"))
    by_score = by_key.groupBy(score).agg(F.sum("c").alias("all"), pairs("c").cast("bigint").alias("same"))
    return by_score.agg(
        (pairs("all").cast("bigint") - F.coalesce(F.sum("same"), F.lit(0))).alias("distinct_ties"), F.coalesce(F.sum("same"), F.lit(0)).alias("duplicate_ties")
    )


def staircase(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Rows whose y is above that of every row before them in the order of x."""
    return ordered.above_all_before(df, [x, y, tie], y)


def logistic_contrast(x: Column, k: Column, c: Column) -> Column:
    """A logistic curve pinned to 0 at 0 and to 1 at 1."""
    sigmoid = lambda z: 1 / (1 + F.exp(-z))
    low, high = sigmoid(-k * c), sigmoid(k * (1 - c))
    return (sigmoid(k * (x - c)) - low) / (high - low)


def threshold_contrast(raw: Column) -> Column:
    """A steep step near the top with a flat tail below, on a grid of millionths."""
    clamp = lambda z: F.least(F.lit(1.0), F.greatest(F.lit(0.0), z))
    high = clamp((raw - 0.91) / 0.08)
    tail = F.when((high == 0) & (raw > 0.1), 0.1 + (raw - 0.1) * 0.1).otherwise(raw)
    return F.floor(clamp(0.98 * high + 0.02 * tail) * 1e6 + 0.5) / 1e6


def margin_report(pairs: DataFrame, good: str, bad: str, self_match: str) -> DataFrame:
    return pairs.agg(
        F.round(F.avg(F.col(good) - F.col(bad)), 6).alias("margin"),
        F.count(F.when(F.col(good) > F.col(bad), 1)).alias("ordered"),
        F.round(F.least(F.lit(1.0), F.min(self_match)), 6).alias("self_match"),
        F.count("*").alias("n"),
    )
