"""Catalogue queries for cleaning and flattening, over pages, documents, events and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import etl as T
from quillon.plans.catalogue import register
from quillon.session import table

_ONE = lambda c: f"trim(regexp_replace({c}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"


@register("collapse_ws", f"SELECT doc_id, md5({_ONE('text')}) AS k, length({_ONE('text')}) AS n FROM documents")
def collapse_ws(spark, sf_dir):
    line = T.one_line(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(line).alias("k"), F.length(line).cast("bigint").alias("n"))


_BARE = r"regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g')"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_entity}', '{_sign}')"


@register("html_strip", f"SELECT page_id, {_ONE(_BARE)} AS body FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("body"))


@register("mutate_text", r"""
WITH b AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'Gusts of 42 and 7 the same. ' WHEN item_id % 3 = 1 THEN 'There is 5 in the box. ' ELSE '' END || text AS t FROM benchmark),
n AS (SELECT *, regexp_extract(t, '([0-9]{1,9})', 1) AS d, regexp_extract(t, '(?s)^(.*?)(?:^|[^A-Za-z0-9_])the(?:$|[^A-Za-z0-9_])', 0) AS h, regexp_extract(t, '(?s)^(.*?)(?:^|[^A-Za-z0-9_])is(?:$|[^A-Za-z0-9_])', 0) AS i FROM b),
m AS (SELECT item_id, t, [CASE WHEN d = '' THEN t ELSE regexp_replace(t, '[0-9]{1,9}', CAST(CASE WHEN CAST(d AS BIGINT) >= 10 THEN CAST(d AS BIGINT) - 10 ELSE CAST(d AS BIGINT) + 10 END AS VARCHAR)) END,
   regexp_replace(t, '(?s)^(.*?)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])', '\1\2a\3'), regexp_replace(t, '(?s)^(.*?)(^|[^A-Za-z0-9_])is($|[^A-Za-z0-9_])', '\1\2is not\3'), t || ' in Atlantis', 'Not so: ' || t] AS a FROM n)
SELECT item_id, list_filter(a[(item_id % 5) + 1:5] || a[1:item_id % 5], lambda x: x <> t)[1] AS mutated FROM m""")
def mutate_text(spark, sf_dir):
    lead = F.when(F.col("item_id") % 3 == 0, "Gusts of 42 and 7 the same. ").when(F.col("item_id") % 3 == 1, "There is 5 in the box. ").otherwise("")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat(lead, "text").alias("t"))
    return b.select("item_id", T.mutate(F.col("t"), F.col("item_id")).alias("mutated"))


def _registry(spark, sf_dir):
    """Intents are nations, entries their suppliers; nested by grouping, as a capture would come."""
    s = table(spark, sf_dir, "supplier")
    entry = F.struct(F.col("s_suppkey").cast("int").alias("registration_id"), (F.col("s_suppkey") % 5).cast("int").alias("rank"),
                     F.when(F.col("s_acctbal") > 0, "active").otherwise("pending").alias("activation_status"), F.col("s_acctbal").alias("eval_score"),
                     F.when(F.col("s_acctbal") < 2000, "low score").alias("rejection_reason"))
    per = s.groupBy(F.concat(F.lit("intent-"), F.col("s_nationkey")).alias("k")).agg(
        F.struct(F.struct(F.max(F.col("s_suppkey").cast("int")).alias("registration_id"), F.max("s_acctbal").alias("eval_score")).alias("champion"), F.collect_list(entry).alias("entries")).alias("v"))
    return per.select(F.from_json(F.to_json(F.map_from_arrays(F.array("k"), F.array("v"))), T.REGISTRY).alias("intents"))


@register("registry_flatten", """
SELECT 'intent-' || s_nationkey AS intent, CAST(max(s_suppkey) OVER (PARTITION BY s_nationkey) AS INTEGER) AS champion, CAST(s_suppkey AS INTEGER) AS registration_id, CAST(s_suppkey % 5 AS INTEGER) AS rank,
  CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'pending' END AS activation_status, s_acctbal AS eval_score, CASE WHEN s_acctbal < 2000 THEN 'low score' END AS rejection_reason FROM supplier""")
def registry_flatten(spark, sf_dir):
    return T.flatten_registry(_registry(spark, sf_dir), "intents")


@register("registry_counts", """
SELECT 'intent-' || s_nationkey AS intent, count(*) AS entries, count(*) FILTER (WHERE s_acctbal < 2000) AS rejected, count(*) FILTER (WHERE s_acctbal <= 0) AS pending FROM supplier GROUP BY s_nationkey""")
def registry_counts(spark, sf_dir):
    flat = T.flatten_registry(_registry(spark, sf_dir), "intents")
    return flat.groupBy("intent").agg(F.count("registration_id").alias("entries"), F.count("rejection_reason").alias("rejected"), F.count(F.when(F.col("activation_status") == "pending", 1)).alias("pending"))


@register("json_props", """
SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, '{"event":"' || min(event_type) || '","n":' || count(*) || '}' AS packed FROM events GROUP BY 1""")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k INT")["k"]
    per = table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.min("event_type").alias("event"))
    return per.select("k", "n", F.to_json(F.struct("event", "n")).alias("packed"))


@register("keyword_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(line), 'licensed|password|token|http')) AS hits FROM l GROUP BY doc_id""")
def keyword_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.count(F.when(F.lower("line").rlike("licensed|password|token|http"), 1)).alias("hits"))
