"""Windows, nearest rows and rollups over time-stamped rows.

Every operator takes column names, groups by a key and leaves the order of work to Spark: ranges are equi-joins with a range
residual or window frames, and nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import scalars as S

#: Hours that are looked through together for the nearest one that has rows.
BLOCK_HOURS = 1000


def horizon_summary(df: DataFrame, key: str, ts: str, value: str, probability: str, code: str, hours: int = 24) -> DataFrame:
    """Per key, from its first row over the given hours (both ends in): extremes, and the probability range of wet rows if any is wet."""
    anchor = df.groupBy(key).agg(F.min(ts).alias("anchor"))
    inside = df.join(anchor, key).where(F.col(ts) <= F.col("anchor") + F.expr(f"INTERVAL {hours} HOURS"))
    wet = S.is_precipitation(F.col(code))
    counted = lambda x: F.when(F.col("any_wet") & ~wet, None).otherwise(x)
    flagged = inside.withColumn("any_wet", F.max(wet).over(Window.partitionBy(key)))
    return flagged.groupBy(key).agg(
        F.min("anchor").alias("anchor"),
        F.count("*").alias("n_rows"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        S.dominant_condition(F.col(code)).alias("condition"),
        F.min(counted(F.col(probability))).alias("probability_min"),
        F.max(counted(F.col(probability))).alias("probability_max"),
    )


def storm_rollup(df: DataFrame, key: str, ts: str, wind: str, gust: str, rain: str, probability: str, code: str, listed: int = 4) -> DataFrame:
    """Per key: peaks, total rain, risk, and the first hours with thunder or with wind over 25 knots."""
    thunder = F.col(code).between(95, 99)
    rows = df.select(
        key,
        ts,
        *(F.round(F.col(c), 1).alias(c) for c in (rain,)),
        F.round(F.col(wind) * 3.6, 1).alias("wind_kmh"),
        F.round(F.col(wind), 1).alias("wind_ms"),
        F.round(F.col(gust) * 3.6, 1).alias("gust_kmh"),
        F.col(probability).alias("p"),
        thunder.alias("thunder"),
    )
    strong = F.col("wind_ms") > S.HIGH_WIND_MS
    peaks = rows.groupBy(key).agg(
        F.max("wind_kmh").alias("wind_max"),
        F.max("gust_kmh").alias("gust_max"),
        F.round(F.coalesce(F.sum(rain), F.lit(0.0)), 1).alias("rain_total"),
        F.max(rain).alias("rain_max"),
        F.max("p").alias("probability_max"),
        F.max("thunder").alias("any_thunder"),
        F.count(F.when(F.col("thunder"), 1)).alias("thunder_hours"),
        F.count(F.when(strong, 1)).alias("strong_hours"),
        _first_times(F.col("thunder"), ts, listed).alias("thunder_at"),
        _first_times(strong, ts, listed).alias("strong_at"),
    )
    score = S.risk_score(F.col("gust_max"), F.col("wind_max"), F.col("probability_max"), F.col("rain_max"), F.col("any_thunder"))
    return peaks.withColumn("risk_score", score).withColumn("risk_label", S.risk_label(F.col("risk_score")))


def _first_times(test: Column, ts: str, listed: int) -> Column:
    times = F.sort_array(F.collect_list(F.when(test, F.date_format(ts, "yyyy-MM-dd'T'HH:mm'Z'"))))
    other = F.when(F.size(times) > listed, " and other hours").otherwise("")
    return F.concat(F.array_join(F.slice(times, 1, listed), ", "), other)


def nearest_rows(grid: DataFrame, rows: DataFrame, grid_ts: str, ts: str, order: str) -> DataFrame:
    """For each grid time the row nearest in time; at equal distance the earlier one, then by ``order``.

    Both sides are put in one order within an hour, each grid time looks back and ahead for the last and the first row, and the
    nearer one stays. The rows at the ends of the nearest hours that have any come from a table with one row per hour, in
    blocks of ``BLOCK_HOURS``, whose own ends form a table of a few rows. No task sees more than an hour's rows or a block's hours.
    """
    named = rows.select(F.col(ts).alias("t"), F.struct(F.col(ts).alias("t"), *(F.col(c) for c in rows.columns if c != ts)).alias("row"), F.col(order).alias("o"))
    # Of rows that share a time the least in order counts; from here on a time has one row.
    named = named.where("t IS NOT NULL").groupBy("t").agg(F.min(F.struct("o", "row"))["row"].alias("row"))
    asked = grid.select(F.col(grid_ts).alias("t"))
    hour = F.floor(F.unix_micros(F.col("t").cast("timestamp")) / 3_600_000_000)
    both = named.select("t", "row").unionByName(asked, allowMissingColumns=True).withColumn("hour", hour)
    # A frame that ends at the partition's end is read anew for each row; looking back in reverse order reads each row once.
    upto = lambda t: F.last("row", ignorenulls=True).over(Window.partitionBy("hour").orderBy(t, F.col("row").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0))
    firsts = named.groupBy(hour.alias("hour")).agg(F.min(F.struct("t", "row")).alias("first"), F.max(F.struct("t", "row")).alias("last"))
    hours = asked.select(hour.alias("hour")).distinct().join(firsts, "hour", "full").withColumn("block", F.floor(F.col("hour") / BLOCK_HOURS))
    blocks = hours.groupBy("block").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    last = lambda name, w: F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    outside = blocks.select("block", last("last", Window.orderBy("block")).alias("before_block"), last("first", Window.orderBy(F.desc("block"))).alias("after_block"))
    per_block = Window.partitionBy("block")
    ends = (
        hours.withColumn("before", last("last", per_block.orderBy("hour")))
        .withColumn("after", last("first", per_block.orderBy(F.desc("hour"))))
        .join(outside, "block")
        .select("hour", F.coalesce("before", "before_block").alias("before"), F.coalesce("after", "after_block").alias("after"))
    )
    found = (
        both.withColumn("prev", upto(F.col("t")))
        .withColumn("next", upto(F.desc("t")))
        .where(F.col("row").isNull())
        .join(ends, "hour", "left")
        .withColumn("prev", F.coalesce("prev", "before.row"))
        .withColumn("next", F.coalesce("next", "after.row"))
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ahead_by, back_by = micros("next.t") - micros("t"), micros("t") - micros("prev.t")
    nearer = F.when(F.col("prev").isNull() | (ahead_by < back_by), F.col("next")).otherwise(F.col("prev"))
    return found.select(F.col("t").alias(grid_ts), nearer.alias("row"))


def sessions(df: DataFrame, key: str, ts: str, gap_minutes: int) -> DataFrame:
    """Runs of rows of a key without a longer pause: start, end and size."""
    order = Window.partitionBy(key).orderBy(ts)
    fresh = (F.col(ts) > F.lag(ts).over(order) + F.expr(f"INTERVAL {gap_minutes} MINUTES")).cast("int")
    marked = df.withColumn("session", F.sum(F.coalesce(fresh, F.lit(0))).over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def last_known(df: DataFrame, key: str, ts: str, value: Column, order: str) -> DataFrame:
    """Each row with the key's latest value that is not null, and whether that is an older one."""
    upto = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("known", F.last(value, ignorenulls=True).over(upto)).withColumn("stale", value.isNull())


def first_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n)


def first_seen(df: DataFrame, key: str, value: str, order: list[str], n: int) -> DataFrame:
    """The first n distinct values of a key in the order in which they first appear."""
    once = df.groupBy(key, value).agg(F.min(F.struct(*order)).alias("at"))
    ranked = once.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("rn") <= n)
    return ranked.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", value))), lambda x: x[value]), ", ").alias("first_seen"))


def transpose(blocks: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Parallel arrays to rows; a short array gives nulls."""
    return blocks.select(key, F.posexplode(F.arrays_zip(*columns)).alias("pos", "x")).select(key, "pos", *(F.col(f"x.{c}").alias(c) for c in columns))
