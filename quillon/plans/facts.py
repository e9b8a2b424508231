"""Catalogue queries for typed facts, over reports written from the events and over given texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import facts as X
from quillon.functions import scalars as S
from quillon.plans.catalogue import register
from quillon.session import ship_package, table


def _reports(spark, sf_dir):
    """One short report per event: temperature, wind and humidity."""
    ship_package(spark)
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    text = F.concat(F.lit("Temperature "), F.round(v / 2, 1).cast("string"), F.lit("°C with wind speed "), F.round(v / 4, 1).cast("string"), F.lit(" m/s and humidity "), k.cast("string"), F.lit("%"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", text.alias("text"))


@register("number_facts", """
SELECT event_id, kind, value FROM (SELECT event_id, unnest([{'kind': 'temperature', 'value': round(value / 2, 1)}, {'kind': 'wind', 'value': round(value / 4, 1)},
  {'kind': 'humidity', 'value': CAST(json_extract_string(props, '$.k') AS DOUBLE)}], recursive := true) FROM events)""")
def number_facts(spark, sf_dir):
    return _reports(spark, sf_dir).select("event_id", F.explode(X.fact_rows(F.col("text"), "forecast")).alias("f")).select("event_id", "f.kind", "f.value")


_PAIRED = """
WITH e AS (SELECT event_id, round(value / 2, 1) AS t, round(value / 4, 1) AS w, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS h,
  lag(round(value / 2, 1)) OVER o AS t0, lag(round(value / 4, 1)) OVER o AS w0, lag(CAST(json_extract_string(props, '$.k') AS DOUBLE)) OVER o AS h0 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT event_id, CASE WHEN abs(t - t0) <= 0.5 THEN 0 WHEN abs(t - t0) <= 2 THEN -0.01 ELSE -0.08 END AS pt, CASE WHEN abs(w - w0) <= 2 THEN 0 ELSE -0.04 END AS pw, CASE WHEN abs(h - h0) <= 5 THEN 0 ELSE -0.05 END AS ph FROM e WHERE t0 IS NOT NULL)
"""


def _with_before(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _reports(spark, sf_dir).withColumn("before", before).where("before IS NOT NULL")


@register("fact_penalties", _PAIRED + """
SELECT event_id, round(CAST(greatest(-0.45, pt + pw + ph - CASE WHEN pt < 0 THEN 0.05 ELSE 0 END - CASE WHEN pw < 0 THEN 0.05 ELSE 0 END - CASE WHEN ph < 0 THEN 0.025 ELSE 0 END) AS DOUBLE), 4) AS adjustment FROM p""")
def fact_penalties(spark, sf_dir):
    """The whole adjustment of the forecast lane: both reports have the same facts, so wrong ones cost more."""
    adjustment = X.fact_adjustment(F.lit(""), F.col("before"), F.col("text"), "forecast")
    return _with_before(spark, sf_dir).select("event_id", F.round(adjustment, 4).alias("adjustment"))


@register("fact_pairing", _PAIRED + """SELECT event_id, unnest(['temperature', 'wind', 'humidity']) AS kind, round(CAST(unnest([pt, pw, ph]) AS DOUBLE), 4) AS penalty FROM p""")
def fact_pairing(spark, sf_dir):
    paired = F.explode(X.fact_pairs(F.col("before"), F.col("text"), "forecast")).alias("p")
    return _with_before(spark, sf_dir).select("event_id", paired).select("event_id", "p.kind", F.round("p.penalty", 4).alias("penalty"))


@register("range_violation", """SELECT event_id, round(value / 4, 1) < round(20 - value / 4, 1) AS crossed FROM events""")
def range_violation(spark, sf_dir):
    """Whether a report's high lies below its low; the two stand too far apart to take each other's words."""
    ship_package(spark)
    shown = lambda x: F.concat(F.round(x, 1).cast("string"), F.lit("°C"))
    text = F.concat(F.lit("The high is "), shown(F.col("value") / 4), F.lit("." + "-" * 120 + "The low is "), shown(20 - F.col("value") / 4))
    return table(spark, sf_dir, "events").select("event_id", X.range_violation(text).alias("crossed"))


@register("date_parse", """SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS iso, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS named FROM orders""")
def date_parse(spark, sf_dir):
    """Days from texts with an ISO date and with a month's name."""
    ship_package(spark)
    due = lambda form: F.concat(F.lit("due "), F.date_format("o_orderdate", form), F.lit("."))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.date_rows(due("yyyy-MM-dd"))[0].alias("iso"), X.date_rows(due("MMMM d, yyyy"))[0].alias("named"))


@register("duration_compare", """
WITH d AS (SELECT event_id, event_id % 9 AS a, event_id % 7 AS b FROM events)
SELECT event_id, CAST(a * 24 AS INTEGER) AS hours, a >= 1 AND b >= 1 AND a * 24 <> b AS differs FROM d""")
def duration_compare(spark, sf_dir):
    """The hours that "N-day" and "for N hours" stand for; a number out of range is no duration."""
    ship_package(spark)
    a, b = F.col("event_id") % 9, F.col("event_id") % 7
    days = X.duration_rows(F.concat(a.cast("string"), F.lit("-day outlook")))
    hours = X.duration_rows(F.concat(F.lit("for "), b.cast("string"), F.lit(" hours")))
    read = table(spark, sf_dir, "events").select("event_id", days.alias("x"), hours.alias("y"))
    return read.select("event_id", F.coalesce(F.get("x", F.lit(0)), F.lit(0)).alias("hours"), ((F.size("x") == 1) & (F.size("y") == 1) & (F.get("x", F.lit(0)) != F.get("y", F.lit(0)))).alias("differs"))


@register("coord_mismatch", """
WITH p AS (SELECT c_custkey, c_acctbal / 200 AS lat, c_custkey % 5 / 10.0 AS off FROM customer)
SELECT c_custkey, abs(CAST(printf('%.2f', lat) AS DOUBLE) - CAST(printf('%.2f', lat + off) AS DOUBLE)) > 0.2 AS far FROM p""")
def coord_mismatch(spark, sf_dir):
    """Whether two reports' coordinates are more than 0.2 degrees apart, at the boundary by the figures as written."""
    ship_package(spark)
    lat, off = F.col("c_acctbal") / 200, F.col("c_custkey") % 5 / 10.0
    text = lambda x: F.concat(F.lit("at coordinates "), S.fixed(x, 2), F.lit(", 10.50 now"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.far_coordinates(text(lat), text(lat + off)).alias("far"))


@register("unit_consistency", """SELECT event_id, abs(round(value / 2, 1) - (round(value, 1) - 32) * 5 / 9) > 1 AS trips FROM events""")
def unit_consistency(spark, sf_dir):
    """Whether a text's two temperatures, in two units, are over a degree apart."""
    ship_package(spark)
    v = F.col("value")
    text = F.concat(F.round(v / 2, 1).cast("string"), F.lit("°C ("), F.round(v, 1).cast("string"), F.lit("°F)"))
    return table(spark, sf_dir, "events").select("event_id", X.unit_conflict(text).alias("trips"))


@register("stale_observation", """
WITH e AS (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events)
SELECT event_id, epoch(date_trunc('minute', after)) - epoch(date_trunc('minute', ts)) > 3600 AS stale FROM e WHERE after IS NOT NULL""")
def stale_observation(spark, sf_dir):
    """Whether a report is over an hour older than the user's next one, by the times in their texts."""
    ship_package(spark)
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("after", after).where("after IS NOT NULL")
    text = lambda c: F.concat(F.lit("weather as of "), F.date_format(c, "yyyy-MM-dd'T'HH:mm'Z'"))
    return rows.select("event_id", X.stale_answer(text("after"), text("ts")).alias("stale"))


@register("place_penalty", """
WITH c AS (SELECT c_custkey, c_nationkey % 3 AS k FROM customer) SELECT c_custkey, CAST(CASE k WHEN 0 THEN 0.0 WHEN 1 THEN -0.12 ELSE -0.30 END AS DOUBLE) AS cost FROM c""")
def place_penalty(spark, sf_dir):
    """Answers that name the place asked for, none, and another one."""
    ship_package(spark)
    k = F.col("c_nationkey") % 3
    name = F.col("c_mktsegment")
    answer = F.when(k == 0, F.concat(F.lit("Rain in "), name)).when(k == 1, "Rain at the location").otherwise("Rain in Atlantis")
    cost = X.place_cost(F.concat(F.lit("What is the weather in "), name, F.lit("?")), F.concat(F.lit("Rain in "), name), answer)
    return table(spark, sf_dir, "customer").select("c_custkey", cost.alias("cost"))
