"""Nested captures and tabular sweeps: JSON and CSV in, JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE = (
    "scores ARRAY<STRUCT<id STRING, intent_id STRING, question STRING, ground_truth STRING, converted_answer STRING, miner_answer STRING, score DOUBLE>>"
)
SWEEP = "k DOUBLE, centre DOUBLE, margin DOUBLE, agreement DOUBLE, self_match DOUBLE, ordering INT, total INT, ties INT"


def read_capture(spark: SparkSession, path: str, intent: str | None = None) -> DataFrame:
    """One row per score, of one intent if it is named."""
    rows = spark.read.schema(CAPTURE).option("multiLine", True).json(path).select(F.explode("scores").alias("s")).select("s.*")
    return rows.where(F.col("intent_id") == intent) if intent else rows


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """A sweep's CSV; a missing column is an error before anything is read."""
    have = spark.read.option("header", True).csv(path).columns
    wanted = [x.split()[0] for x in SWEEP.split(", ")]
    if lacking := [c for c in wanted if c not in have]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    text = spark.read.option("header", True).csv(path)
    return text.select(*(F.col(n).cast(t).alias(n) for n, t in (x.split() for x in SWEEP.split(", "))))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Objects with sorted keys, one to a line."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.text(path)


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: whether it parses as JSON, and its text."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.try_parse_json("value").isNotNull().alias("is_json"), F.col("value"))
