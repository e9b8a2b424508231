"""Catalogue queries for the evaluation statistics, over lineitem, orders, labels and generated grids."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import evalstats as E
from quillon.operators import ordered
from quillon.plans.catalogue import register
from quillon.session import table


@register("avg_rank", """
SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS r FROM lineitem""")
def avg_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return E.average_rank(rows, "l_quantity", "r", by="l_returnflag").select("l_orderkey", "l_linenumber", "r")


@register("spearman", """
WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT l_returnflag, round(corr(x, y), 6) AS rho FROM r GROUP BY l_returnflag""")
def spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    ranked = E.average_rank(E.average_rank(rows, "l_quantity", "x", "l_returnflag"), "l_extendedprice", "y", "l_returnflag")
    return ranked.groupBy("l_returnflag").agg(F.round(E.pearson(F.col("x"), F.col("y")), 6).alias("rho"))


@register("pearson_guarded", """
WITH p AS (SELECT l_linenumber, l_quantity AS x, CASE WHEN l_linenumber = 1 THEN 5.0 ELSE l_extendedprice END AS y FROM lineitem)
SELECT l_linenumber, CASE WHEN var_pop(x) = 0 OR var_pop(y) = 0 THEN CASE WHEN bool_and(x = y) THEN 1.0 ELSE 0.0 END ELSE round(corr(x, y), 6) END AS r FROM p GROUP BY 1""")
def pearson_guarded(spark, sf_dir):
    y = F.when(F.col("l_linenumber") == 1, 5.0).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.round(E.pearson(F.col("l_quantity"), y), 6).alias("r"))


@register("percentile_nearest", """
WITH o AS (SELECT l_shipdate, l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(v) FILTER (WHERE i = ((n - 1) * 50 + 50) // 100) AS p50, max(v) FILTER (WHERE i = ((n - 1) * 90 + 50) // 100) AS p90,
  max(v) FILTER (WHERE i = ((n - 1) * 99 + 50) // 100) AS p99 FROM o GROUP BY l_returnflag""")
def percentile_nearest(spark, sf_dir):
    return E.nearest_percentile(table(spark, sf_dir, "lineitem"), "l_extendedprice", [(50, 100), (90, 100), (99, 100)], by="l_returnflag")


@register("tie_counts", """
WITH a AS (SELECT l_quantity AS s, l_partkey AS k, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT CAST((SELECT sum(n * (n - 1) / 2) FROM (SELECT s, sum(c) AS n FROM a GROUP BY s)) - sum(c * (c - 1) / 2) AS BIGINT) AS distinct_ties, CAST(sum(c * (c - 1) / 2) AS BIGINT) AS duplicate_ties FROM a""")
def tie_counts(spark, sf_dir):
    return E.tie_counts(table(spark, sf_dir, "lineitem"), "l_quantity", "l_partkey")


_PAIRS_SQL = "SELECT o_orderkey, o_orderpriority, o_totalprice / 500000 AS good, (o_custkey % 100) / 100.0 AS bad, least(1, 0.75 + o_totalprice / 1000000) AS self FROM orders"


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", (F.col("o_totalprice") / 500000).alias("good"), (F.col("o_custkey") % 100 / 100.0).alias("bad"),
        F.least(F.lit(1.0), 0.75 + F.col("o_totalprice") / 1000000).alias("self"),
    )


@register("margin_ordering", f"""
SELECT round(avg(good - bad), 6) AS margin, count(*) FILTER (WHERE good > bad) AS ordered, round(least(1, min(self)), 6) AS self_match, count(*) AS n FROM ({_PAIRS_SQL})""")
def margin_ordering(spark, sf_dir):
    return E.margin_report(_pairs(spark, sf_dir), "good", "bad", "self")


@register("gate_report", f"""
WITH m AS (SELECT o_orderpriority, avg(good - bad) AS margin, least(1, min(self)) AS self_match, count(*) FILTER (WHERE good > bad) AS ordered, count(*) AS n, corr(good, bad) AS agreement FROM ({_PAIRS_SQL}) GROUP BY 1)
SELECT o_orderpriority, self_match >= 0.75 AS self_gate, margin >= 0.15 AS margin_gate, ordered * 2 >= n AS ordering_gate, agreement >= 0.6 AS agreement_gate,
  self_match >= 0.75 AND margin >= 0.15 AND ordered * 2 >= n AND agreement >= 0.6 AS passed FROM m""")
def gate_report(spark, sf_dir):
    m = _pairs(spark, sf_dir).groupBy("o_orderpriority").agg(
        F.avg(F.col("good") - F.col("bad")).alias("margin"), F.least(F.lit(1.0), F.min("self")).alias("self_match"),
        F.count(F.when(F.col("good") > F.col("bad"), 1)).alias("ordered"), F.count("*").alias("n"), E.pearson(F.col("good"), F.col("bad")).alias("agreement"),
    )
    gates = m.select(
        "o_orderpriority", (F.col("self_match") >= 0.75).alias("self_gate"), (F.col("margin") >= 0.15).alias("margin_gate"),
        (F.col("ordered") * 2 >= F.col("n")).alias("ordering_gate"), (F.col("agreement") >= 0.6).alias("agreement_gate"),
    )
    return gates.withColumn("passed", F.col("self_gate") & F.col("margin_gate") & F.col("ordering_gate") & F.col("agreement_gate"))





@register("param_sweep", f"""
WITH p AS ({_PAIRS_SQL}), grid AS (SELECT 4 + 4 * i AS k, (3 + j) / 10.0 AS c FROM range(8) a(i), range(7) b(j)),
s AS (SELECT k, c, 1 / (1 + exp(k * c)) AS lo, 1 / (1 + exp(-k * (1 - c))) AS hi FROM grid),
x AS (SELECT k, c, (1 / (1 + exp(-k * (good - c))) - lo) / (hi - lo) AS g, (1 / (1 + exp(-k * (bad - c))) - lo) / (hi - lo) AS b FROM p, s)
SELECT CAST(k AS INTEGER) AS k, CAST(c AS DOUBLE) AS c, round(avg(g - b), 6) AS margin, count(*) FILTER (WHERE g > b) AS ordered FROM x GROUP BY k, c""")
def param_sweep(spark, sf_dir):
    """The grid (56 points) is exploded beside each pair, so the pairs are read once and only sums per point are shuffled."""
    grid = F.array(*(F.struct(F.lit(4 + 4 * i).alias("k"), F.lit((3 + j) / 10).alias("c")) for i in range(8) for j in range(7)))
    points = _pairs(spark, sf_dir).select("good", "bad", F.explode(grid).alias("q")).select("good", "bad", F.col("q.k").alias("k"), F.col("q.c").alias("c"))
    kd = F.col("k").cast("double")
    scored = points.select("k", "c", E.logistic_contrast(F.col("good"), kd, F.col("c")).alias("g"), E.logistic_contrast(F.col("bad"), kd, F.col("c")).alias("b"))
    return scored.groupBy("k", "c").agg(F.round(F.avg(F.col("g") - F.col("b")), 6).alias("margin"), F.count(F.when(F.col("g") > F.col("b"), 1)).alias("ordered"))


@register("running_max_staircase", """
WITH d AS (SELECT CAST(date_trunc('day', o_orderdate) AS DATE) AS x, round(max(o_totalprice), 2) AS y FROM orders GROUP BY 1),
w AS (SELECT *, max(y) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d) SELECT x, y FROM w WHERE b IS NULL OR b < y""")
def running_max_staircase(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("x")).agg(F.round(F.max("o_totalprice"), 2).alias("y"))
    return E.staircase(days, "x", "y", "x")


@register("constrained_argmax", """
SELECT o_custkey, margin, agreement, ties FROM (SELECT o_custkey, round(avg(o_totalprice), 2) AS margin, max(o_totalprice) AS agreement, count(*) AS ties FROM orders GROUP BY 1)
WHERE agreement >= 200000 AND ties >= 3 ORDER BY margin DESC, agreement DESC, ties, o_custkey LIMIT 1""")
def constrained_argmax(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 2).alias("margin"), F.max("o_totalprice").alias("agreement"), F.count("*").alias("ties"))
    return per.where("agreement >= 200000 AND ties >= 3").orderBy(F.desc("margin"), F.desc("agreement"), "ties", "o_custkey").limit(1).select("o_custkey", "margin", "agreement", "ties")


@register("semi_anti_champion", """
SELECT o_orderpriority, count(*) FILTER (WHERE c_custkey IS NOT NULL) AS matched, count(*) FILTER (WHERE c_custkey IS NULL) AS missing
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY 1""")
def semi_anti_champion(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    champions = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    hit = orders.join(champions, "o_custkey", "left_semi").withColumn("hit", F.lit(1))
    miss = orders.join(champions, "o_custkey", "left_anti").withColumn("hit", F.lit(0))
    return hit.unionByName(miss).groupBy("o_orderpriority").agg(F.sum("hit").alias("matched"), F.sum(1 - F.col("hit")).alias("missing"))


@register("positional_join", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer), b AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier)
SELECT c_nationkey AS nation, a.rn AS rn, c_custkey, s_suppkey FROM a JOIN b ON c_nationkey = s_nationkey AND a.rn = b.rn""")
def positional_join(spark, sf_dir):
    a = ordered.positions(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey"), ["nation"], "c_custkey", "rn")
    b = ordered.positions(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey"), ["nation"], "s_suppkey", "rn")
    return a.join(b, ["nation", "rn"])


@register("holdout_split", """
WITH n AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS c FROM documents)
SELECT lang, count(*) FILTER (WHERE rn <= c * 78 // 100) AS fit, count(*) FILTER (WHERE rn > c * 78 // 100) AS holdout FROM n GROUP BY lang""")
def holdout_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id")
    n = ordered.positions(rows, ["lang"], "doc_id", "rn").join(rows.groupBy("lang").agg(F.count("*").alias("c")), "lang")
    fit = (F.col("rn") <= F.floor(F.col("c") * 78 / 100)).cast("int")
    return n.groupBy("lang").agg(F.sum(fit).alias("fit"), F.sum(1 - fit).alias("holdout"))


@register("template_cross", """
SELECT r_regionkey, t, CASE t WHEN 0 THEN 'What is ' || r_name || '?' WHEN 1 THEN 'Name ' || r_name WHEN 2 THEN r_name || ' is which region?' ELSE 'Tell me about ' || r_name END AS question,
  CASE WHEN r_regionkey < (SELECT count(*) * 78 // 100 FROM region) THEN 'fit' ELSE 'holdout' END AS part FROM region, (SELECT unnest([0, 1, 2, 3]) AS t)""")
def template_cross(spark, sf_dir):
    name = F.col("r_name")
    templates = F.array(F.concat(F.lit("What is "), name, F.lit("?")), F.concat(F.lit("Name "), name), F.concat(name, F.lit(" is which region?")), F.concat(F.lit("Tell me about "), name))
    region = table(spark, sf_dir, "region")
    size = region.agg(F.floor(F.count("*") * 78 / 100).alias("cut"))
    return region.join(F.broadcast(size), F.lit(True)).select("r_regionkey", F.posexplode(templates).alias("t", "question"), F.when(F.col("r_regionkey") < F.col("cut"), "fit").otherwise("holdout").alias("part"))


@register("contrast_curve", """
WITH r AS (SELECT doc_id, least(1, n_chars / 4093.0) AS raw FROM documents), h AS (SELECT *, least(1, greatest(0, (raw - 0.91) / 0.08)) AS high FROM r)
SELECT doc_id, round(floor(least(1, greatest(0, 0.98 * high + 0.02 * CASE WHEN high = 0 AND raw > 0.1 THEN 0.1 + (raw - 0.1) * 0.1 ELSE raw END)) * 1e6 + 0.5) / 1e6, 6) AS score FROM h""")
def contrast_curve(spark, sf_dir):
    raw = F.least(F.lit(1.0), F.col("n_chars") / 4093.0)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(E.threshold_contrast(raw), 6).alias("score"))


@register("logistic_curve", """
SELECT doc_id, round((1 / (1 + exp(-16 * (least(1, n_chars / 4000.0) - 0.4))) - 1 / (1 + exp(6.4))) / (1 / (1 + exp(-9.6)) - 1 / (1 + exp(6.4))), 6) AS score FROM documents""")
def logistic_curve(spark, sf_dir):
    raw = F.least(F.lit(1.0), F.col("n_chars") / 4000.0)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(E.logistic_contrast(raw, F.lit(16.0), F.lit(0.4)), 6).alias("score"))


@register("length_quality", "SELECT doc_id, round(1 / (1 + exp(-(octet_length(encode(text)) - 50) / 20.0)), 6) AS quality FROM documents")
def length_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(1 / (1 + F.exp(-(F.octet_length("text") - 50) / 20.0)), 6).alias("quality"))
