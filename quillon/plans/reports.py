"""Catalogue queries for report rows and sentences; an event stands for an hour, a user for a place."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import reports as R
from quillon.functions.tables import COMPASS, CONDITIONS
from quillon.operators.reports import storm_answer
from quillon.plans.catalogue import register
from quillon.session import table

_POINTS = "[" + ", ".join(f"'{p}'" for p in COMPASS) + "]"
_SLUGS = "MAP {" + ", ".join(f"{c}: '{s}'" for c, _, s in CONDITIONS) + "}"
_TENTH = "CAST(CASE WHEN (abs({0}) * 4) % 2 = 1 THEN sign({0}) * floor(abs({0}) * 10 + 0.5) / 10 ELSE CAST(printf('%.1f', {0}) AS DOUBLE) END AS DOUBLE)"
_HOUR = """h AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 11 <> 0 THEN value END AS t, CASE WHEN event_id % 3 = 0 THEN value / 8 ELSE 0.0 END AS p, CAST(event_id % 101 AS DOUBLE) AS c, value / 4 + 0.05 AS w, value / 2 AS g, value * 7 AS d, CAST(event_id % 100 AS INTEGER) AS k FROM events)"""


def _hours(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    hour = F.struct(
        F.col("ts").alias("time"), F.when(e % 11 != 0, v).alias("temperature"), F.when(e % 3 == 0, v / 8).otherwise(0.0).alias("precipitation"), (e % 101).cast("double").alias("probability"),
        (v / 4 + 0.05).alias("wind"), (v / 2).alias("gust"), (v * 7).alias("direction"), (v - 10).alias("dew_point"), (e % 100).cast("int").alias("code"), e.alias("event_id"),
    )
    return table(spark, sf_dir, "events").select("event_id", "user_id", hour.alias("hour"))


def _tenth(x):
    return _TENTH.format(f"({x})")


_SLUG = f"coalesce({_SLUGS}[k], 'unknown_' || k)"


@register("hour_projection", f"""
WITH {_HOUR} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%MZ') AS time, coalesce({_tenth("t")}, -99) AS temp_c, {_tenth("p")} AS precip_mm, CAST(floor(c + 0.5) AS BIGINT) AS precip_probability_pct, {_tenth("w / 3.6")} AS wind_ms, {_SLUG} AS conditions FROM h""")
def hour_projection(spark, sf_dir):
    rows = _hours(spark, sf_dir).select("event_id", R.forecast_rows(F.array("hour"), F.lit("km/h"))[0].alias("r"))
    return rows.select("event_id", "r.time", F.coalesce("r.temp_c", F.lit(-99.0)).alias("temp_c"), "r.precip_mm", "r.precip_probability_pct", "r.wind_ms", "r.conditions")


@register("storm_projection", f"""
WITH {_HOUR} SELECT event_id, {_tenth("w")} AS wind_ms, {_tenth("w * 3.6")} AS wind_kmh, {_tenth("w * 1.94384449")} AS wind_knots, {_tenth("g * 3.6")} AS gust_kmh, CAST(floor(d + 0.5) AS BIGINT) AS wind_direction_deg,
  {_POINTS}[CAST((CAST(floor((d + 11.25) / 22.5) AS BIGINT) % 16 + 16) % 16 AS INTEGER) + 1] AS wind_direction_compass, k AS weather_code, k BETWEEN 95 AND 99 AS thunderstorm FROM h""")
def storm_projection(spark, sf_dir):
    rows = _hours(spark, sf_dir).select("event_id", R.storm_rows(F.array("hour"), F.lit("m/s"))[0].alias("r"))
    return rows.select("event_id", *(f"r.{c}" for c in ("wind_ms", "wind_kmh", "wind_knots", "gust_kmh", "wind_direction_deg", "wind_direction_compass", "weather_code", "thunderstorm")))


@register("current_projection", f"""
WITH {_HOUR} SELECT event_id, coalesce({_tenth("t")}, -99) AS temperature_c, coalesce({_tenth("t * 9 / 5 + 32")}, -99) AS temperature_f, {_tenth("w * 0.44704")} AS wind_speed_ms, {_tenth("w * 0.44704 * 3.6")} AS wind_speed_kmh, {_SLUG} AS condition_slug FROM h""")
def current_projection(spark, sf_dir):
    h = F.col("hour")
    current = F.struct(h["time"].alias("time"), h["temperature"].alias("temperature"), h["dew_point"].alias("apparent"), h["probability"].alias("humidity"), h["precipitation"].alias("precipitation"), h["wind"].alias("wind"), h["direction"].alias("direction"), F.lit(1000.0).alias("pressure"), F.lit(5.0).alias("cloud"), h["code"].alias("code"))
    rows = _hours(spark, sf_dir).select("event_id", R.current_values(current, F.lit("mph")).alias("r"))
    return rows.select("event_id", F.coalesce("r.temperature_c", F.lit(-99.0)).alias("temperature_c"), F.coalesce("r.temperature_f", F.lit(-99.0)).alias("temperature_f"), "r.wind_speed_ms", "r.wind_speed_kmh", "r.condition_slug")


def _places(spark, sf_dir):
    """Per user and day the hours in order: a group is at most a day's events of one user."""
    hours = _hours(spark, sf_dir).groupBy("user_id", F.to_date("hour.time").cast("string").alias("day")).agg(F.sort_array(F.collect_list("hour")).alias("hours"))
    return hours.select("user_id", "day", F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("place"), "hours")


@register("window_report", f"""
WITH {_HOUR}, r AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, ts, event_id, {_tenth("t")} AS t, {_tenth("p")} AS p, CASE WHEN map_contains({_SLUGS}, k) THEN k END AS k FROM h),
a AS (SELECT user_id, day, max(strftime(ts, '%Y-%m-%dT%H:%MZ')) AS last, min(t) AS lo, max(t) AS hi, round(sum(p), 6) AS rain, bool_or(k BETWEEN 51 AND 67 OR k BETWEEN 71 AND 86 OR k BETWEEN 95 AND 99) AS wet, bool_or(k >= 95) AS thunder, bool_or(k IN (45, 48)) AS fog, bool_or(k = 3) AS c3, bool_or(k = 2) AS c2, bool_or(k = 1) AS c1, bool_or(k = 0) AS c0 FROM r GROUP BY ALL),
b AS (SELECT *, CASE WHEN wet AND thunder THEN 'scattered showers or thunderstorms' WHEN wet THEN 'rain or showers' WHEN fog THEN 'fog' WHEN c3 THEN 'overcast' WHEN c2 THEN 'partly cloudy' WHEN c1 THEN 'mainly clear' WHEN c0 THEN 'clear' END AS cond,
  regexp_replace(CAST({_tenth("rain")} AS VARCHAR), '\\.0$', '') AS total FROM a)
SELECT user_id, day, 'The forecast for the next 24 hours at User ' || user_id || ' is valid through ' || last || ', with ' || coalesce('temperatures ranging from ' || CAST(floor(lo + 0.5) AS BIGINT) || 'C to ' || CAST(floor(hi + 0.5) AS BIGINT) || 'C', 'hourly temperature data')
  || coalesce(' and ' || cond || ' conditions', '') || '.' || CASE WHEN rain = 0 THEN ' No precipitation is expected.' WHEN rain < 1 THEN ' Minimal precipitation is expected (' || total || 'mm total).' ELSE ' Total precipitation is expected to reach ' || total || 'mm.' END AS answer FROM b""")
def window_report(spark, sf_dir):
    none = F.lit(None).cast("string")
    places = _places(spark, sf_dir).withColumn("rows", R.forecast_rows(F.col("hours"), F.lit("m/s")))
    return places.select("user_id", "day", R.window_text(F.col("place"), F.col("rows"), F.lit(24), none, none).alias("answer"))


@register("storm_report")
def storm_report(spark, sf_dir):
    """Storm answers (tests hold the sentences to literal texts)."""
    places = storm_answer(_places(spark, sf_dir), F.col("place"), F.col("hours"), F.lit("m/s"), F.lit(24), F.lit("wind at 100u"))
    return places.select("user_id", "day", "answer", "storm.risk_score")


@register("hourly_report")
def hourly_report(spark, sf_dir):
    """Concise hourly answers (tests hold the sentences to literal texts)."""
    places = _places(spark, sf_dir).withColumn("rows", R.forecast_rows(F.col("hours"), F.lit("m/s")))
    return places.select("user_id", "day", R.hourly_text(F.col("place"), F.col("rows"), F.lit(1), F.array("day"), F.lit("")).alias("answer"))


@register("horizon_values", f"""
WITH {_HOUR}, r AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, coalesce(k BETWEEN 51 AND 67 OR k BETWEEN 71 AND 86 OR k BETWEEN 95 AND 99, false) AS wet FROM h), w AS (SELECT user_id, day, bool_or(wet) AS any_wet FROM r GROUP BY ALL)
SELECT user_id, day, coalesce(min(t), -99) AS low_c, coalesce(max(t), -99) AS high_c, min(c) FILTER (WHERE wet OR NOT any_wet) AS probability_min_pct, max(c) FILTER (WHERE wet OR NOT any_wet) AS probability_max_pct FROM r JOIN w USING (user_id, day) GROUP BY ALL""")
def horizon_values(spark, sf_dir):
    start = F.col("hours")[0]["time"]
    found = _places(spark, sf_dir).select("user_id", "day", R.horizon(F.col("hours"), start).alias("x"))
    return found.select("user_id", "day", F.coalesce("x.low_c", F.lit(-99.0)).alias("low_c"), F.coalesce("x.high_c", F.lit(-99.0)).alias("high_c"), "x.probability_min_pct", "x.probability_max_pct")
