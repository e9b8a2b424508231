"""Catalogue queries for the answer score (rows only: token positions and 64-bit hashes are beyond SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import projection, scoring
from quillon.operators.textpairs import conversation_pairs
from quillon.plans.catalogue import register
from quillon.session import ship_package, table


def _pairs(spark, sf_dir):
    ship_package(spark)
    return conversation_pairs(table(spark, sf_dir, "conversations"))


@register("rank_answer")
def rank_answer(spark, sf_dir):
    scored = scoring.score_pairs(_pairs(spark, sf_dir), "question", "question", "answer")
    return scored.select("conv_id", "turn", F.round("raw", 6).alias("raw"), "score")


@register("lexical_blend")
def lexical_blend(spark, sf_dir):
    """Each benchmark item against itself with words dropped: the more is dropped, the lower the blend."""
    ship_package(spark)
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("dropped"))
    words = F.split("text", " ")
    cut = F.array_join(F.filter(words, lambda w, i: (i % 8) >= F.col("dropped")), " ")
    scored = scoring.score_pairs(items.withColumn("answer", cut).withColumn("question", F.lit("what is it")), "question", "text", "answer")
    return scored.select("item_id", "dropped", F.round("raw", 6).alias("raw"))


@register("tie_slots")
def tie_slots(spark, sf_dir):
    scored = scoring.score_pairs(_pairs(spark, sf_dir), "question", "answer", "answer", lane="forecast")
    return scored.select("conv_id", "turn", "score")


@register("acronym_bridge")
def acronym_bridge(spark, sf_dir):
    """Whole turns of conversations, their words capitalised, against the capitals of each three words of theirs."""
    ship_package(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "").alias("w"))
    first = F.transform("w", lambda x: F.upper(F.left(x, F.lit(1))))
    capitals = turns.select("conv_id", "turn", F.initcap(F.array_join("w", " ")).alias("truth"), first.alias("c"))
    three = F.transform("c", lambda c, i: F.concat_ws("", c, F.get("c", i + 1), F.get("c", i + 2)))
    named = capitals.select("conv_id", "turn", "truth", F.array_join(three, " ").alias("answer"), F.lit("").alias("question"))
    return scoring.score_pairs(named, "question", "truth", "answer").select("conv_id", "turn", F.round("raw", 6).alias("raw"))


@register("breakdown_answer")
def breakdown_answer(spark, sf_dir):
    """The six fields of each answer, by the SQL function."""
    scoring.register_functions(spark)
    _pairs(spark, sf_dir).createOrReplaceTempView("quillon_pairs")
    scored = spark.sql("SELECT conv_id, turn, breakdown_answer(question, question, answer) AS b FROM quillon_pairs")
    return scored.select("conv_id", "turn", *(F.round(f"b.{f}", 6).alias(f) for f in scoring.FIELDS))


@register("projection_cosine")
def projection_cosine(spark, sf_dir):
    near = projection.similarity(F.col("question"), F.col("answer"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(near, 6).alias("cos"))
