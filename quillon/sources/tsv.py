"""Tab-separated corpora without a header: fixtures, scores and traffic; and their sinks.

Fields are parted by a tab, or by the two characters backslash and t where a line has no tab. Lines that are blank or begin
with # are left out. A line of another arity, a score outside 0 to 1 and an empty corpus are errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIXTURE = ("question", "ground_truth", "good_answer", "bad_answer")
BASELINE = ("id", "self_match", "good", "bad")
TRAFFIC = ("id", "question", "ground_truth", "answer")
CHAMPION = ("id", "score")


def fields(line: Column) -> Column:
    return F.when(F.instr(line, "\t") > 0, F.split(line, "\t", -1)).otherwise(F.split(line, r"\\t", -1))


def parse_lines(lines: DataFrame, names: tuple[str, ...], scores: tuple[str, ...] = ()) -> DataFrame:
    """``value`` holds the lines; columns named in ``scores`` become numbers. A line of wrong shape fails the query that reads it."""
    line = F.col("value")
    kept = lines.where((F.trim(line) != "") & ~line.startswith("#"))
    parts = kept.select(fields(line).alias("f"), line)
    right = F.size("f") == len(names)
    made = []
    for i, name in enumerate(names):
        field = F.get("f", F.lit(i))
        if name in scores:
            number = field.try_cast("double")
            ok = right & number.between(0, 1)
            field = F.when(ok, number).otherwise(F.raise_error(F.concat(F.lit(f"{name} is not a score between 0 and 1: "), line)).cast("double"))
        elif i == 0:
            field = F.when(right, field).otherwise(F.raise_error(F.concat(F.lit(f"a line without {len(names)} fields: "), line)).cast("string"))
        made.append(field.alias(name))
    return parts.select(*made)


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path), FIXTURE)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path), BASELINE, BASELINE[1:])


def read_traffic(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path), TRAFFIC)


def read_champion(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path), CHAMPION, CHAMPION[1:])


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if not df.limit(1).count():
        raise ValueError(f"{what} holds no rows")
    return df


def with_champion(traffic: DataFrame, champion: DataFrame) -> DataFrame:
    """Each traffic row with its champion's score, the first one of an id; an id without a score is an error."""
    in_order = champion.withColumn("_line", F.monotonically_increasing_id())  # by file and place, before anything is shuffled
    first = in_order.groupBy("id").agg(F.min_by("score", "_line").alias("score"))
    joined = traffic.join(first, "id", "left")
    missing = F.raise_error(F.concat(F.lit("no champion score for "), F.col("id"))).cast("double")
    return joined.withColumn("score", F.when(F.col("score").isNotNull(), F.col("score")).otherwise(missing))


def write_tsv(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """White space inside fields is collapsed, so that every record is one line."""
    flat = [F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " ")) for c in columns]
    df.select(F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in flat)).alias("value")).write.text(path)
