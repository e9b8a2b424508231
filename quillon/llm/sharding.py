"""Sharding by sampled splitters, under the law ``bytes``: shards of near equal size.

Records are ordered by a 63-bit key, the upper 40 bits from the text's hash and the lower 23 from the id's hash, so
equal texts are neighbours, and by a tie number of their own, so that records alike in every respect can be told apart. Keys
are drawn with a chance in proportion to the record's size; the weighted quantiles of the draw cut the keys into
``RANGES_PER_SHARD`` ranges for each shard; exact sizes of the ranges then give the cuts between shards. First cuts
fall between texts. A range that is overfull (such as one hot text, or one record repeated many times) is drawn again
at full width, tie number included, and subdivided until none is left that can be.

The tie number is given when the light table (without texts) is written, and read back from there ever after, so a task that
is run again places its records as before. What reaches the driver: a draw of ``DRAWS`` keys per range, and one row per range,
whatever the number of records. No task gathers a shard: a row's slot is its rank within its range plus the rows of the
earlier ranges of its shard.

Defined cases: a null text has 8 bytes and the checksum of nothing; null or repeated ids and repeated rows, also very many of
one kind, are placed row by row (rows alike in every respect take their slots in any order); an empty table gives an empty
result; columns other than the id and the text are ignored. A single record larger than a shard's share cannot be divided.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.session import Scratch, ship_package, table

SHARDS = 24
RANGES_PER_SHARD = 128
DRAWS = 8
#: A range that holds more than this many times the mean beside its largest record is overfull.
OVERFULL = 4.0
#: Each round divides an overfull range into many; so many rounds without an end mean a fault, not a hard table.
MOST_ROUNDS = 40
RECORD_BYTES = 8
ID_BITS = 23
TIE_BITS = 31


def record_key(doc_id: Column, text: Column) -> Column:
    whole = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - 40)
    own = F.xxhash64(doc_id).bitwiseAND((1 << ID_BITS) - 1)
    return F.shiftleft(whole, ID_BITS).bitwiseOR(own)


class Cuts:
    """Splitters (key, tie) in order; a record belongs to the range after the last splitter that is not above it."""

    def __init__(self, keys: np.ndarray, ties: np.ndarray):
        pairs = pd.DataFrame({"key": keys.astype(np.int64), "tie": ties.astype(np.int64)}).drop_duplicates().sort_values(["key", "tie"])
        self.keys, self.ties = pairs["key"].to_numpy(), pairs["tie"].to_numpy()
        self.known, index = np.unique(self.keys, return_inverse=True)
        self.marks = (2 * index.astype(np.int64) + 1 << TIE_BITS) + self.ties

    def place(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """A key becomes the number of the splitters' keys below it, twice, plus one if it is one of them; ties decide there."""
        if not len(self.known):
            return np.zeros(len(keys), np.int32)
        at = np.searchsorted(self.known, keys)
        same = self.known[np.minimum(at, len(self.known) - 1)] == keys
        return np.searchsorted(self.marks, (2 * at + same << TIE_BITS) + np.where(same, ties, 0), side="right").astype(np.int32)

    def joined(self, others: list[tuple[np.ndarray, np.ndarray]]) -> Cuts:
        return Cuts(np.concatenate([self.keys, *(k for k, _ in others)]), np.concatenate([self.ties, *(t for _, t in others)]))


def draw(light: DataFrame, wanted: int, total_bytes: int, seed: int) -> pd.DataFrame:
    """Keys drawn with a chance in proportion to size, by hash, so that a task run again draws the same.

    At most ``wanted`` rows are expected, whatever the number of records. ``weight``: the bytes a drawn key stands for.
    """
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(wanted / max(total_bytes, 1)))
    number = F.pmod(F.xxhash64("row", "key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (
        light.where(number < chance)
        .select("key", "tie", (F.col("size") / chance).alias("weight"))
        .toPandas()
        .sort_values(["key", "tie"], ignore_index=True)
    )


def quantile_cuts(sample: pd.DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys and ties at the weighted quantiles 1/parts, 2/parts ..."""
    if sample.empty:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    upto = np.cumsum(sample["weight"].to_numpy())
    at = np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts), len(sample) - 1)
    return sample["key"].to_numpy(np.int64)[at], sample["tie"].to_numpy(np.int64)[at]


def _ranged(light: DataFrame, cuts: Cuts) -> DataFrame:
    sent = light.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf(T.IntegerType())
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(sent.value.place(key.to_numpy(np.int64), tie.to_numpy(np.int64)))

    return light.withColumn("range", place("key", "tie"))


def _measured(ranged: DataFrame) -> pd.DataFrame:
    ends = F.struct("key", "tie")
    return (
        ranged.groupBy("range")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), (F.sum("size") - F.max("size")).alias("rest"), F.min(ends).alias("low"), F.max(ends).alias("high"))
        .select("range", "bytes", "rows", "rest", (F.col("low") < F.col("high")).alias("divisible"))
        .toPandas()
        .sort_values("range", ignore_index=True)
    )


def shard(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, key, range, shard, slot."""
    spark = df.sparkSession
    ship_package(spark)
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    read = df.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        (F.octet_length(raw) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        record_key(F.col(doc_id), F.col(text)).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    with Scratch(spark) as scratch:
        light = scratch.keep(read.withColumn("tie", F.pmod(F.xxhash64("row"), F.lit(1 << TIE_BITS))))
        total, _ = light.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        parts = shards * RANGES_PER_SHARD
        keys, _ = quantile_cuts(draw(light, DRAWS * parts, total, 0), parts)
        between = np.unique(keys & ~np.int64((1 << ID_BITS) - 1))
        cuts = Cuts(between, np.zeros(len(between), np.int64))
        for again in range(1, MOST_ROUNDS + 1):
            sizes = _measured(_ranged(light, cuts))
            full = sizes[(sizes["rest"] > OVERFULL * total / parts) & sizes["divisible"]]
            if full.empty:
                break
            part = _ranged(light, cuts).join(F.broadcast(spark.createDataFrame(full[["range"]])), "range", "left_semi")
            sample = draw(part, DRAWS * parts, int(full["bytes"].sum()), again)
            where = cuts.place(sample["key"].to_numpy(np.int64), sample["tie"].to_numpy(np.int64))
            cuts = cuts.joined([quantile_cuts(sample[where == r.range], int(np.ceil(r.bytes * parts / total))) for r in full.itertuples()])
        else:
            raise RuntimeError(f"ranges are still overfull after {MOST_ROUNDS} rounds")
    middle = sizes["bytes"].cumsum() - sizes["bytes"] / 2
    sizes["shard"] = np.minimum((middle * shards / max(total, 1)).astype(np.int32), shards - 1)
    sizes["before"] = (sizes.groupby("shard")["rows"].cumsum() - sizes["rows"]).astype(np.int64)
    places = spark.createDataFrame(
        sizes[["range", "shard", "before"]].astype({"range": np.int32}), "range int, shard int, before bigint"
    )
    rank = F.row_number().over(Window.partitionBy("range").orderBy("key", "tie", "row"))
    return (
        _ranged(light, cuts)
        .withColumn("rank", rank)
        .join(F.broadcast(places), "range")
        .select(
            "doc_id", "size", "text_crc32", "key", "range", "shard", (F.col("before") + F.col("rank") - 1).alias("slot")
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
