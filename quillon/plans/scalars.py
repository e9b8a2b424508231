"""Catalogue queries for scalar functions, over events, orders, lineitem, nation and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.functions.tables import COMPASS, CONDITIONS
from quillon.plans.catalogue import register
from quillon.session import table

_POINTS = "[" + ", ".join(f"'{p}'" for p in COMPASS) + "]"
_CODES = "(VALUES " + ", ".join(f"({c}, '{p}', '{s}')" for c, p, s in CONDITIONS) + ") c(code, phrase, slug)"


@register("compass", f"""SELECT l_orderkey, l_linenumber, {_POINTS}[CAST((((CAST(floor((l_extendedprice / 100 - 200 + 11.25) / 22.5) AS INTEGER) % 16) + 16) % 16) AS INTEGER) + 1] AS point FROM lineitem""")
def compass(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.compass_point(F.col("l_extendedprice") / 100 - 200).alias("point"))


@register("unit_convert", """
SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN value / 3.6 WHEN 1 THEN value * 0.44704 ELSE value END, 6) AS ms, round(value * 9 / 5 + 32, 6) AS f, round(value * 1.94384449, 6) AS knots,
  CAST(floor(value - 50 + 0.5) AS BIGINT) AS whole FROM events""")
def unit_convert(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("km/h"), F.lit("mph"), F.lit("m/s")), (F.col("event_id") % 3 + 1).cast("int"))
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(S.wind_ms(v, unit), 6).alias("ms"), F.round(S.fahrenheit(v), 6).alias("f"), F.round(v * S.KNOTS_PER_MS, 6).alias("knots"), S.round_half_up(v - 50).alias("whole"))


@register("code_lookup", f"""
SELECT event_id, coalesce(phrase, 'unknown conditions (code ' || event_id % 100 || ')') AS phrase, coalesce(slug, 'unknown_' || event_id % 100) AS slug, coalesce(code, -1) AS code FROM events LEFT JOIN {_CODES} ON code = event_id % 100""")
def code_lookup(spark, sf_dir):
    code = (F.col("event_id") % 100).cast("int")
    named = table(spark, sf_dir, "events").select("event_id", S.condition_phrase(code).alias("phrase"), S.condition_slug(code).alias("slug"))
    return named.withColumn("code", F.coalesce(S.condition_code(F.col("slug")), F.lit(-1)))


@register("condition_class", f"""
SELECT event_id, CASE WHEN e.c BETWEEN 95 AND 99 THEN 'Thunderstorm' WHEN e.c BETWEEN 51 AND 57 THEN 'Drizzle' WHEN e.c BETWEEN 61 AND 67 OR e.c BETWEEN 80 AND 82 THEN 'Rain' WHEN e.c BETWEEN 71 AND 77 THEN 'Snow'
  WHEN e.c BETWEEN 85 AND 86 THEN 'Snow showers' ELSE coalesce(phrase, 'unknown conditions (code ' || e.c || ')') END AS kind FROM (SELECT event_id, event_id % 100 AS c FROM events) e LEFT JOIN {_CODES} ON code = e.c""")
def condition_class(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.coarse_condition((F.col("event_id") % 100).cast("int")).alias("kind"))


@register("precip_code", """SELECT event_id, (event_id % 100 BETWEEN 51 AND 67) OR (event_id % 100 BETWEEN 71 AND 86) OR (event_id % 100 BETWEEN 95 AND 99) AS wet FROM events""")
def precip_code(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.is_precipitation(F.col("event_id") % 100).alias("wet"))


@register("date_span", """
SELECT o_orderkey, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-30') + 1 > 0 THEN CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-30') + 1 AS INTEGER) ELSE 0 END AS span,
  CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR) AS next_day FROM orders""")
def date_span(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(S.day_span(day, F.lit("1996-06-30").cast("date")), F.lit(0)).alias("span"), F.date_add(day, 1).cast("string").alias("next_day"))


@register("window_clamp", """
SELECT o_orderkey, CAST(least(7, greatest(1, coalesce(nullif(o_orderkey % 11 - 2, 0), 3))) AS INTEGER) AS days, CAST(least(168, greatest(1, o_orderkey % 200)) AS INTEGER) AS hours FROM orders""")
def window_clamp(spark, sf_dir):
    days = F.least(F.lit(7), F.greatest(F.lit(1), F.coalesce(F.nullif(F.col("o_orderkey") % 11 - 2, F.lit(0)), F.lit(3))))
    return table(spark, sf_dir, "orders").select("o_orderkey", days.cast("int").alias("days"), F.least(F.lit(168), F.greatest(F.lit(1), F.col("o_orderkey") % 200)).cast("int").alias("hours"))


@register("iso_format", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%MZ') AS minute, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS second, strftime(ts - INTERVAL 2 HOURS, '%Y-%m-%dT%H:%MZ') AS stale FROM events""")
def iso_format(spark, sf_dir):
    text = lambda c, p: F.date_format(c, p)
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", text(ts, "yyyy-MM-dd'T'HH:mm'Z'").alias("minute"), text(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("second"), text(ts - F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm'Z'").alias("stale"))


@register("alias_coalesce", """
SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE NULL END), ''), nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_mktsegment || ' ' END), ''), c_name) AS place FROM customer""")
def alias_coalesce(spark, sf_dir):
    blank, segment = F.when(F.col("c_custkey") % 3 == 0, "  "), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(S.clean(blank), S.clean(segment), "c_name").alias("place"))


@register("range_validate", """
WITH p AS (SELECT c_custkey, c_acctbal / 50 AS lat, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal / 30 END AS lon FROM customer)
SELECT c_custkey, CASE WHEN lon IS NULL THEN 'both or neither' WHEN NOT lat BETWEEN -90 AND 90 THEN 'latitude' WHEN NOT lon BETWEEN -180 AND 180 THEN 'longitude' ELSE 'ok' END AS status FROM p""")
def range_validate(spark, sf_dir):
    lat, lon = F.col("c_acctbal") / 50, F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") / 30)
    status = F.when(lon.isNull() != lat.isNull(), "both or neither").when(~lat.between(-90, 90), "latitude").when(~lon.between(-180, 180), "longitude").otherwise("ok")
    return table(spark, sf_dir, "customer").select("c_custkey", status.alias("status"))


@register("place_label", """SELECT n_nationkey, n_name || ', ' || r_name || CASE WHEN n_nationkey % 2 = 0 THEN ', Earth' ELSE '' END AS label FROM nation JOIN region ON n_regionkey = r_regionkey""")
def place_label(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    last = F.when(F.col("n_nationkey") % 2 == 0, "Earth").otherwise("")
    return n.select("n_nationkey", S.place_label(F.col("n_name"), F.col("r_name"), last).alias("label"))


_REQUESTS = ["temperature_2m", "precipitation", "precipitation_probability, wind-speed", "temperature precipitation wind_speed", "humidity", "", "Temperature and Precipitation Probability and Wind Speed"]


@register("field_terms", """
WITH q AS (SELECT unnest([%s]) AS q), t AS (SELECT q, regexp_replace(lower(q), '[_-]+', ' ', 'g') AS s FROM q),
l AS (SELECT q, list_filter([CASE WHEN contains(s, 'temperature') THEN 'temperature in Celsius' END, CASE WHEN contains(s, 'precipitation probability') THEN 'precipitation probability' WHEN contains(s, 'precipitation') THEN 'precipitation' END,
   CASE WHEN contains(s, 'wind speed') THEN 'wind speed' END], lambda x: x IS NOT NULL) AS l FROM t)
SELECT q, CASE len(l) WHEN 0 THEN '' WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE l[1] || ', ' || l[2] || ', and ' || l[3] END AS phrase FROM l""" % ", ".join(f"'{q}'" for q in _REQUESTS))
def field_terms(spark, sf_dir):
    q = table(spark, sf_dir, "region").limit(1).select(F.explode(F.array(*(F.lit(x) for x in _REQUESTS))).alias("q"))
    return q.select("q", S.joined_terms(S.field_terms(F.col("q"))).alias("phrase"))


@register("fixed_decimals")
def fixed_decimals(spark, sf_dir):
    """One-decimal texts by the exact binary value, which SQL's rounding does not give."""
    return table(spark, sf_dir, "events").select("event_id", S.to_fixed1(F.col("value")).alias("text"))
