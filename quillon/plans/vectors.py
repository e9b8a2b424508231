"""Catalogue queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.plans.catalogue import register
from quillon.session import table

_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_COS = lambda a, b: f"greatest(0, {_DOT(a, b)} / (sqrt({_DOT(a, a)}) * sqrt({_DOT(b, b)})))"


@register("cosine_pairs", f"""SELECT a.vec_id, round({_COS('a.embedding', 'b.embedding')}, 4) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 4).alias("cos"))


_CENTROIDS = "SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i"


@register("centroids", f"SELECT label, CAST(i AS INTEGER) AS i, round(x, 5) AS x FROM ({_CENTROIDS})")
def centroids(spark, sf_dir):
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("x"))


@register("nearest_vector", f"""
WITH c AS (SELECT label, list(x ORDER BY i) AS c FROM ({_CENTROIDS}) GROUP BY label), s AS (SELECT vec_id, c.label AS nearest, round({_COS('embedding', 'c')}, 4) AS cos FROM embeddings, c)
SELECT vec_id, arg_max(nearest, (cos, -nearest)) AS nearest, max(cos) AS cos FROM s GROUP BY vec_id""")
def nearest_vector(spark, sf_dir):
    """Each vector's nearest centroid: the centroids (one per label) go along as one array, so vectors are read once."""
    e = table(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    every = centre.agg(F.collect_list(F.struct("label", "c")).alias("centres"))
    near = e.join(F.broadcast(every), F.lit(True)).select(
        "vec_id", F.array_max(F.transform("centres", lambda c: F.struct(F.round(V.cosine(F.col("embedding"), c["c"]), 4).alias("cos"), (-c["label"]).alias("l")))).alias("best"))
    return near.select("vec_id", (-F.col("best.l")).alias("nearest"), F.col("best.cos").alias("cos"))


@register("quantize_int8", """
WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS top FROM embeddings),
q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(sign(x) * floor(abs(CAST(x AS DOUBLE) * 127 / top) + 0.5) AS INTEGER)) AS q FROM m)
SELECT vec_id, CAST(list_sum(q) AS BIGINT) AS total, CAST(list_max(q) AS INTEGER) AS high, array_to_string(q, ',') AS q FROM q""")
def quantize_int8(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").select("vec_id", V.quantized(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.array_max("q").alias("high"), F.array_join(F.col("q").cast("array<string>"), ",").alias("q"))


@register("min_cosine_gate", f"""
WITH m AS (SELECT embedding, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 2)) AS r FROM embeddings) SELECT round(min({_COS('embedding', 'r')}), 4) AS worst, min({_COS('embedding', 'r')}) >= 0.998 AS passed FROM m""")
def min_cosine_gate(spark, sf_dir):
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 2))
    cos = table(spark, sf_dir, "embeddings").select(V.cosine(F.col("embedding"), rounded).alias("cos"))
    return cos.agg(F.round(F.min("cos"), 4).alias("worst"), (F.min("cos") >= 0.998).alias("passed"))


@register("normalized_vectors", f"SELECT vec_id, round(sqrt({_DOT('embedding', 'embedding')}), 5) AS length, round(embedding[1] / sqrt({_DOT('embedding', 'embedding')}), 5) AS first FROM embeddings")
def normalized_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("length"), F.round(V.normalized(F.col("embedding"))[0], 5).alias("first"))
