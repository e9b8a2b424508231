"""Catalogue queries for requests in prose, over all turns of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import requests as Q
from quillon.plans.catalogue import register
from quillon.session import table


@register("request_numbers", r"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS s, lower(coalesce(text, '')) AS l FROM conversations),
n AS (SELECT *, TRY_CAST(regexp_extract(s, '\b(\d{1,2})\s*[- ]?days?\b', 1, 'i') AS INTEGER) AS d,
  nullif(TRY_CAST(regexp_extract(s, '\b(\d{1,3})\s*[- ]?(?:hours?|h)\b', 1, 'i') AS INTEGER), 0) AS h,
  TRY_CAST(nullif(regexp_extract(s, '\b(?:latitude|lat)\s*[:=]?\s*(-?\d+(?:\.\d+)?)', 1, 'i'), '') AS DOUBLE) AS la, TRY_CAST(nullif(regexp_extract(s, '\b(?:longitude|lon)\s*[:=]?\s*(-?\d+(?:\.\d+)?)', 1, 'i'), '') AS DOUBLE) AS lo,
  TRY_CAST(nullif(regexp_extract(s, '\bcoordinates?\s*[:=]?\s*\(?\s*(-?\d+(?:\.\d+)?)\s*[,/]\s*(-?\d+(?:\.\d+)?)\s*\)?', 1, 'i'), '') AS DOUBLE) AS pa,
  TRY_CAST(nullif(regexp_extract(s, '\bcoordinates?\s*[:=]?\s*\(?\s*(-?\d+(?:\.\d+)?)\s*[,/]\s*(-?\d+(?:\.\d+)?)\s*\)?', 2, 'i'), '') AS DOUBLE) AS po FROM t)
SELECT conv_id, turn, coalesce(d, CAST(ceil(h / 24.0) AS INTEGER), -1) AS days, coalesce(h, -1) AS hours,
  NOT regexp_matches(l, '\bnext\s+24\s+hours?\b') AND regexp_matches(l, '\b(?:hourly|daily|tomorrow|multi[- ]day|\d+\s*[- ]?days?|\d+\s*[- ]?hours?|forecast)\b') AS forecast,
  coalesce(CASE WHEN la IS NOT NULL AND lo IS NOT NULL THEN la ELSE pa END, 999) AS lat, coalesce(CASE WHEN la IS NOT NULL AND lo IS NOT NULL THEN lo ELSE po END, 999) AS lon FROM n""")
def request_numbers(spark, sf_dir):
    t = F.col("text")
    read = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return read.select("conv_id", "turn", F.coalesce(Q.days(t), F.lit(-1)).alias("days"), F.coalesce(Q.hours(t), F.lit(-1)).alias("hours"), Q.wants_forecast(t).alias("forecast"),
                       F.coalesce(Q.coordinates(t)["lat"], F.lit(999.0)).alias("lat"), F.coalesce(Q.coordinates(t)["lon"], F.lit(999.0)).alias("lon"))


@register("prompt_extract")
def prompt_extract(spark, sf_dir):
    """Every turn as a request, normalised (no SQL: the patterns need lookahead)."""
    request = F.create_map(F.lit("question"), F.col("text"))
    read = table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.normalised(request).alias("r"))
    place, days, fields = F.coalesce("r.q", F.lit("")), F.coalesce("r.days", F.lit(Q.DEFAULT_DAYS)), F.col("r.fields")
    return read.select("conv_id", "turn", "r.q", "r.hours", "r.days", Q.framing(F.col("r.text"), place, days, fields).alias("framing"), Q.field_selection(fields).alias("want"))


@register("instants", r"""
WITH e AS (SELECT event_id, ts, event_id % 5 AS k FROM events), t AS (SELECT event_id, ts, k, CASE k WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M+02:00') WHEN 3 THEN strftime(ts, '%Y-%m-%d') ELSE 'seen ' || strftime(ts, '%Y-%m-%dT%H:%MZ') || ' by all' END AS text FROM e)
SELECT event_id, CASE k WHEN 0 THEN strftime(date_trunc('minute', ts) - INTERVAL 9 HOURS, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(date_trunc('minute', ts) - INTERVAL 2 HOURS, '%Y-%m-%dT%H:%M:%SZ') ELSE text END AS stamp,
  CASE WHEN k = 1 THEN strftime(ts - INTERVAL 2 HOURS, '%Y-%m-%dT%H:%M:%SZ') WHEN k = 4 THEN 'seen ' || strftime(ts - INTERVAL 2 HOURS, '%Y-%m-%dT%H:%MZ') || ' by all' ELSE text END AS stale,
  k < 3 OR k = 4 AS clock FROM t""")
def instants(spark, sf_dir):
    """Stamps of times in five spellings, in a zone nine hours ahead, and the same with the first time two hours earlier."""
    as_text = lambda p: F.date_format("ts", p)
    k = F.col("event_id") % 5
    text = (
        F.when(k == 0, as_text("yyyy-MM-dd'T'HH:mm")).when(k == 1, as_text("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, as_text("yyyy-MM-dd'T'HH:mm'+02:00'"))
        .when(k == 3, as_text("yyyy-MM-dd")).otherwise(F.concat(F.lit("seen "), as_text("yyyy-MM-dd'T'HH:mm'Z'"), F.lit(" by all")))
    )
    read = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return read.select("event_id", Q.stamp(F.col("text"), F.lit("Asia/Tokyo")).alias("stamp"), Q.stale_first_time(F.col("text")).alias("stale"), Q.has_clock(F.col("text")).alias("clock"))


@register("request_window", """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) - 1 AS e, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 12 - 2 END AS x, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 170 END AS h, o_orderkey % 2 = 0 AS dated, o_orderkey % 4 = 0 AS clock FROM orders),
d AS (SELECT *, CASE WHEN dated AND date_diff('day', s, e) + 1 > 0 THEN date_diff('day', s, e) + 1 END AS span FROM o)
SELECT o_orderkey, CAST(least(7, greatest(1, coalesce(CASE WHEN span = 1 AND clock AND x IS NULL THEN 2 END, span, CASE WHEN x > 0 THEN x WHEN h > 0 THEN ceil(h / 24.0) ELSE 3 END))) AS INTEGER) AS days,
  CASE WHEN NOT dated THEN '' WHEN e > s THEN CAST(e AS VARCHAR) ELSE CAST(s + 1 AS VARCHAR) END AS fetch_end,
  CASE WHEN span IS NOT NULL AND NOT clock THEN span || '-day hourly weather forecast' WHEN dated AND clock THEN '48-hour hourly weather forecast' ELSE '5-day hourly weather forecast' END AS label FROM d""")
def request_window(spark, sf_dir):
    key = F.col("o_orderkey")
    clock = F.when(key % 4 == 0, "T10:00Z").otherwise("")
    start = F.when(key % 2 == 0, F.concat(F.to_date("o_orderdate").cast("string"), clock))
    end = F.when(key % 2 == 0, F.concat(F.date_add(F.to_date("o_orderdate"), (key % 9 - 1).cast("int")).cast("string"), clock))
    explicit, hours = F.when(key % 3 == 0, (key % 12 - 2).cast("int")), F.when(key % 5 == 0, key % 170)
    return table(spark, sf_dir, "orders").select("o_orderkey", Q.window_days(explicit, hours, start, end).alias("days"), F.coalesce(Q.fetch_end(start, end), F.lit("")).alias("fetch_end"), Q.window_label(start, end, F.lit(5)).alias("label"))
