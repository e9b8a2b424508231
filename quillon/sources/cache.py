"""A cache of raw scores: fixture rows and traffic rows in one Parquet folder, with a version and counts that are checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
FIXTURE, TRAFFIC = "F", "T"


def write_raw_cache(fixtures: DataFrame, traffic: DataFrame, path: str) -> None:
    """fixtures: id, self_match, good, bad; traffic: id, score."""
    both = fixtures.select(F.lit(FIXTURE).alias("kind"), "id", "self_match", "good", "bad").unionByName(traffic.select(F.lit(TRAFFIC).alias("kind"), "id", "score"), allowMissingColumns=True)
    both.write.partitionBy("kind").parquet(f"{path}/rows")
    counts = fixtures.sparkSession.read.parquet(f"{path}/rows").groupBy("kind").count()
    counts.withColumn("version", F.lit(VERSION)).write.json(f"{path}/header")


def read_raw_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fixtures, traffic); another version or other counts than the header's are an error."""
    header = spark.read.schema("kind STRING, count BIGINT, version INT").json(f"{path}/header").collect()
    if any(r.version != VERSION for r in header):
        raise ValueError(f"the cache is of version {header[0].version}, not {VERSION}")
    rows = spark.read.schema("id STRING, self_match DOUBLE, good DOUBLE, bad DOUBLE, score DOUBLE, kind STRING").parquet(f"{path}/rows")
    have = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    if have != {r["kind"]: r["count"] for r in header}:
        raise ValueError(f"the cache holds {have}, not what its header says")
    return rows.where(F.col("kind") == FIXTURE).select("id", "self_match", "good", "bad"), rows.where(F.col("kind") == TRAFFIC).select("id", "score")
