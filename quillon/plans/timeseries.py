"""Catalogue queries over the events table, read as a measurement series.

An event's type stands for a condition code (error 95, purchase 61, signup 45, click 3, view 1), its value for the
temperature and the wind in m/s (a quarter of it), and the k of its properties for a probability.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import scalars as S
from quillon.operators import timeseries as T
from quillon.plans.catalogue import register
from quillon.session import table

CODE_OF_TYPE = {"error": 95, "purchase": 61, "signup": 45, "click": 3, "view": 1}
_CODE_SQL = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {c}" for t, c in CODE_OF_TYPE.items()) + " END"
_K_SQL = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
_WET_SQL = "(code BETWEEN 51 AND 67 OR code BETWEEN 71 AND 86 OR code BETWEEN 95 AND 99)"
_DOMINANT_SQL = f"""CASE WHEN bool_or({_WET_SQL}) AND bool_or(code >= 95) THEN 'scattered showers or thunderstorms'
  WHEN bool_or({_WET_SQL}) THEN 'rain or showers' WHEN bool_or(code IN (45, 48)) THEN 'fog' WHEN bool_or(code = 3) THEN 'overcast'
  WHEN bool_or(code = 2) THEN 'partly cloudy' WHEN bool_or(code = 1) THEN 'mainly clear' WHEN bool_or(code = 0) THEN 'clear' END"""
_LABEL_SQL = "CASE WHEN risk_score >= 0.75 THEN 'high' WHEN risk_score >= 0.5 THEN 'elevated' WHEN risk_score >= 0.25 THEN 'moderate' WHEN risk_score >= 0.1 THEN 'low' ELSE 'none' END"
_ROWS_SQL = f"SELECT *, {_CODE_SQL} AS code, {_K_SQL} AS p FROM events"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.create_map(*(F.lit(x) for pair in CODE_OF_TYPE.items() for x in pair))[F.col("event_type")]
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", S.finite(F.col("value")).alias("value"), code.alias("code"), F.get_json_object("props", "$.k").cast("double").alias("p")
    )


@register("horizon24_summary", f"""
WITH e AS ({_ROWS_SQL}), a AS (SELECT user_id, min(ts) AS anchor FROM e GROUP BY user_id),
i AS (SELECT e.*, anchor, max(CASE WHEN {_WET_SQL} THEN 1 ELSE 0 END) OVER (PARTITION BY e.user_id) AS wet
      FROM e JOIN a ON e.user_id = a.user_id AND ts <= anchor + INTERVAL 24 HOURS),
s AS (SELECT user_id, count(*) AS n_rows, round(min(value), 1) AS low, round(max(value), 1) AS high, {_DOMINANT_SQL} AS condition,
  min(p) FILTER (WHERE wet = 0 OR {_WET_SQL}) AS probability_min, max(p) FILTER (WHERE wet = 0 OR {_WET_SQL}) AS probability_max,
  round(least(1, greatest(max(value) / 4 * 3.6 / 160, least(1, coalesce(max(p) FILTER (WHERE wet = 0 OR {_WET_SQL}), 0) / 100 * 0.4),
        CASE WHEN bool_or(code >= 95) THEN 0.25 ELSE 0 END)), 2) AS risk_score
  FROM i GROUP BY user_id)
SELECT *, {_LABEL_SQL} AS risk_label FROM s""")
def horizon24_summary(spark, sf_dir):
    rows = series(spark, sf_dir)
    summary = T.horizon_summary(rows, "user_id", "ts", "value", "p", "code")
    thunder = F.col("condition") == "scattered showers or thunderstorms"
    score = S.risk_score(F.col("high") / 4 * 3.6, F.lit(None).cast("double"), F.col("probability_max"), F.lit(None).cast("double"), thunder)
    return summary.select(
        "user_id", "n_rows", F.round("low", 1).alias("low"), F.round("high", 1).alias("high"), "condition", "probability_min", "probability_max", score.alias("risk_score")
    ).withColumn("risk_label", S.risk_label(F.col("risk_score")))


def _rollup_sql(unit: str, name: str) -> str:
    return f"""SELECT date_trunc('{unit}', ts)::TIMESTAMP AS {name}, count(*) AS n, round(min(value), 2) AS low, round(max(value), 2) AS high,
      round(coalesce(sum(value), 0), 2) AS total, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1"""


def _rollup(spark, sf_dir, unit, name):
    return series(spark, sf_dir).groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias(name)).agg(
        F.count("*").alias("n"), F.round(F.min("value"), 2).alias("low"), F.round(F.max("value"), 2).alias("high"),
        F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"),
    )


@register("hourly_rollup", _rollup_sql("hour", "hour"))
def hourly_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir, "hour", "hour")


@register("daily_rollup", _rollup_sql("day", "day"))
def daily_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir, "day", "day")


@register("storm_rollup", f"""
WITH e AS (SELECT user_id, ts, round(value / 4 * 3.6, 1) AS wind_kmh, round(value / 4, 1) AS wind_ms, round(value / 3 * 3.6, 1) AS gust_kmh,
             round(p / 10, 1) AS rain, p, code BETWEEN 95 AND 99 AS thunder FROM ({_ROWS_SQL})),
g AS (SELECT user_id, max(wind_kmh) AS wind_max, max(gust_kmh) AS gust_max, round(coalesce(sum(rain), 0), 1) AS rain_total, max(rain) AS rain_max,
  max(p) AS probability_max, bool_or(thunder) AS any_thunder, count(*) FILTER (WHERE thunder) AS thunder_hours,
  count(*) FILTER (WHERE wind_ms > 12.8611) AS strong_hours,
  list_sort(coalesce(list(strftime(ts, '%Y-%m-%dT%H:%MZ')) FILTER (WHERE thunder), [])) AS tt, list_sort(coalesce(list(strftime(ts, '%Y-%m-%dT%H:%MZ')) FILTER (WHERE wind_ms > 12.8611), [])) AS st
  FROM e GROUP BY user_id),
s AS (SELECT *, round(least(1, greatest(greatest(gust_max, wind_max) / 160, least(1, probability_max / 100 * 0.4 + rain_max / 25), CASE WHEN any_thunder THEN 0.25 ELSE 0 END)), 2) AS risk_score FROM g)
SELECT user_id, wind_max, gust_max, rain_total, rain_max, probability_max, any_thunder, thunder_hours, strong_hours,
  array_to_string(tt[1:4], ', ') || CASE WHEN len(tt) > 4 THEN ' and other hours' ELSE '' END AS thunder_at,
  array_to_string(st[1:4], ', ') || CASE WHEN len(st) > 4 THEN ' and other hours' ELSE '' END AS strong_at, risk_score, {_LABEL_SQL} AS risk_label FROM s""")
def storm_rollup(spark, sf_dir):
    rows = series(spark, sf_dir).select("user_id", "ts", (F.col("value") / 4).alias("wind"), (F.col("value") / 3).alias("gust"), (F.col("p") / 10).alias("rain"), "p", "code")
    return T.storm_rollup(rows, "user_id", "ts", "wind", "gust", "rain", "p", "code")


@register("nearest_event", """
WITH g AS (SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS hour FROM events)
SELECT hour, arg_min(event_id, (abs(epoch_us(ts) - epoch_us(hour)), epoch_us(ts), event_id)) AS event_id
FROM g JOIN events ON ts BETWEEN hour - INTERVAL 3 DAYS AND hour + INTERVAL 3 DAYS GROUP BY hour""")
def nearest_event(spark, sf_dir):
    rows = series(spark, sf_dir).select("ts", "event_id")
    grid = rows.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).distinct()
    return T.nearest_rows(grid, rows, "hour", "ts", "event_id").select("hour", F.col("row.event_id").alias("event_id"))


@register("first_seen_distinct_top3", """
WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS seen FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen) AS rn FROM f)
SELECT user_id, string_agg(event_type, ', ' ORDER BY rn) AS first_seen FROM r WHERE rn <= 3 GROUP BY user_id""")
def first_seen_distinct_top3(spark, sf_dir):
    return T.first_seen(series(spark, sf_dir), "user_id", "event_type", ["ts", "event_id"], 3)


@register("precip_bands", f"""
WITH s AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, round(coalesce(sum(p / 100) FILTER (WHERE {_WET_SQL}), 0), 2) AS total,
  floor(min(value) + 0.5) AS low, floor(max(value) + 0.5) AS high FROM ({_ROWS_SQL}) GROUP BY ALL)
SELECT user_id, day, total, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high,
  CASE WHEN total = 0 THEN 'none' WHEN total < 1 THEN 'minimal' ELSE 'total' END AS band FROM s""")
def precip_bands(spark, sf_dir):
    wet = S.is_precipitation(F.col("code"))
    days = series(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.round(F.coalesce(F.sum(F.when(wet, F.col("p") / 100)), F.lit(0.0)), 2).alias("total"),
        S.round_half_up(F.min("value")).cast("bigint").alias("low"), S.round_half_up(F.max("value")).cast("bigint").alias("high"),
    )
    return days.withColumn("band", F.when(F.col("total") == 0, "none").when(F.col("total") < 1, "minimal").otherwise("total"))


@register("first_n_rows", """SELECT user_id, event_id, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS rn FROM events) WHERE rn <= 48""")
def first_n_rows(spark, sf_dir):
    return T.first_n(series(spark, sf_dir), "user_id", ["ts", "event_id"], 48).select("user_id", "event_id", "rn")


@register("columnar_transpose", """
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, event_id AS ids, value AS vals FROM events""")
def columnar_transpose(spark, sf_dir):
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")))
    blocks = series(spark, sf_dir).groupBy("user_id").agg(ordered.alias("x")).select(
        "user_id", F.transform("x", lambda e: e["event_id"]).alias("ids"), F.transform("x", lambda e: e["value"]).alias("vals"))
    return T.transpose(blocks, "user_id", ["ids", "vals"])


@register("tumbling_1h", """SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def tumbling_1h(spark, sf_dir):
    rows = series(spark, sf_dir)
    return rows.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(
        "event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@register("sliding_24h", """
SELECT user_id, event_id, count(*) OVER w AS n, round(max(value) OVER w, 2) AS peak FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def sliding_24h(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-86_400_000_000, 0)
    return series(spark, sf_dir).select("user_id", "event_id", F.count("*").over(w).alias("n"), F.round(F.max("value").over(w), 2).alias("peak"))


@register("session_gap", """
WITH l AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 360 MINUTES THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM l)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def session_gap(spark, sf_dir):
    return T.sessions(series(spark, sf_dir), "user_id", "ts", 360)


@register("last_known_value", """
WITH v AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS known, v IS NULL AS stale FROM v""")
def last_known_value(spark, sf_dir):
    return T.last_known(series(spark, sf_dir), "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")), "event_id").select("event_id", "known", "stale")


@register("stale_flag", """
SELECT event_id, epoch_us(max(ts) OVER (PARTITION BY user_id)) - epoch_us(ts) > 3600000000 AS late FROM events""")
def stale_flag(spark, sf_dir):
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    newest = F.max("ts").over(Window.partitionBy("user_id"))
    return series(spark, sf_dir).select("event_id", (micros(newest) - micros(F.col("ts")) > 3_600_000_000).alias("late"))


@register("ttl_dedup", """
SELECT event_type, CAST(floor(value) AS BIGINT) AS bucket, CAST(floor(epoch(date_trunc('second', ts)) / 60) AS BIGINT) AS minute, min(event_id) AS event_id FROM events GROUP BY ALL""")
def ttl_dedup(spark, sf_dir):
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    return series(spark, sf_dir).groupBy("event_type", F.floor("value").alias("bucket"), minute.alias("minute")).agg(F.min("event_id").alias("event_id"))


@register("lru_keep", """
WITH l AS (SELECT event_type, user_id, max((ts, event_id)) AS used FROM events GROUP BY ALL)
SELECT event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY used DESC) AS rn FROM l) WHERE rn <= 20""")
def lru_keep(spark, sf_dir):
    last = series(spark, sf_dir).groupBy("event_type", "user_id").agg(F.max(F.struct("ts", "event_id")).alias("used"))
    rn = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("used")))
    return last.withColumn("rn", rn).where(F.col("rn") <= 20).select("event_type", "user_id")
