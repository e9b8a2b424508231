"""Tab-separated corpora scored as they arrive: one public score per line, whatever the batch it comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scoring
from quillon.session import ship_package
from quillon.sources import tsv


def scored_lines(spark: SparkSession, path: str, lane: str = "check") -> DataFrame:
    """A stream of id, raw and score over the traffic lines of a folder; stateless, so a batch that is run again gives the same."""
    ship_package(spark)
    traffic = tsv.parse_lines(spark.readStream.text(path), tsv.TRAFFIC)
    return scoring.score_pairs(traffic, "question", "ground_truth", "answer", lane).select("id", "raw", "score")


def write_scores(scored: DataFrame, path: str, checkpoint: str):
    """The stream as tab-separated lines of id and score."""
    line = F.concat_ws("\t", "id", F.format_number("score", 6)).alias("value")
    return scored.select(line).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
