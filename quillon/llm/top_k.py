"""Exact top-k inner products by norm order, SVD rotation and Cauchy-Schwarz bounds.

Vectors are turned by the right singular vectors of the whole table (from its Gram matrix), so that the leading
coordinates carry most of every product, and dealt to range partitions by descending length, where they are read in
blocks. A first pass scores the longest vectors and a share of all others, drawn by hash, and gives each query a k-th best
score. A query needs vectors of at least that score over its own length; queries are dealt to rounds by that need, and a
round reads only the vectors that reach the least need in it. In a block a query whose length times the block's longest
does not reach its k-th best skips the block; for the others vectors are taken by descending length in steps, products of
the leading coordinates are formed, and a vector is dropped when these plus the product of the residual lengths stay below
the k-th best. What is left is scored exactly in whole numbers: pair by pair if it is little, else by one product of the
step. Bounds carry a margin for rounding, and a score that equals the k-th best is kept, so ties are decided by the smaller
id.

Vectors are never joined with queries and never packed into larger rows. Queries go out in rounds of at most about
``ROUND_BYTES``, so what is gathered and broadcast at a time does not grow with the table; the number of rounds does. A task
gives back only the k best of each query. A hot vector only makes ties, which each task cuts to k. Partitions and rounds are
dealt by row, so neither many rows of one vector nor many of one id outgrow one. The number of products grows with the
square of the table.

Defined cases: vectors that are null, or hold a null or a non-finite component, or one of 1e150 or more after scaling, take no
part, nor do rows with a null id; every row counts, so a repeated row is as many candidates, and rows of a query's own id are
not its candidates; if a query id has several rows, the products of all of them are ranked together; shorter vectors count
as filled up with zeros; scores beyond 64 bits are given as the largest or smallest number of 64 bits, and are ranked by
their nearest double, then by id; a query with fewer than k candidates gets all of them; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm.batches import map_batches
from quillon.session import Scratch, ship_package, table

SCALE = 1024
K = 10
QUERY_EVERY = 100
#: Vectors in a block, and queries that are scored together.
BLOCK_ROWS = 4096
QUERY_ROWS = 512
#: Vectors in a range partition.
PART_ROWS = 2 * BLOCK_ROWS
#: Bytes of the vectors of the queries of a round, about.
ROUND_BYTES = 16 << 20
#: Besides the longest vectors one in so many takes part in the first pass.
SEED_EVERY = 16
LEADING = 16
STEP_ROWS = 1024
#: Where the bound leaves a larger share of a step's pairs, the step is scored as a whole.
DENSE = 1 / 32
#: After such a step so many steps go without the bound.
UNBOUND_STEPS = 15
#: Rounds are dealt by at most this many levels of need, and then by row.
NEED_LEVELS = 32
_LARGEST = 1e150
#: Products below this are exact in double precision.
_EXACT = float(1 << 53)


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, whole, row: the vectors that take part, floored, each with a number of its own."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    read = df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vec_id).cast("bigint").alias("vec_id"), scaled.alias("scaled"))
    fine = F.forall("scaled", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _LARGEST))
    # From 2**53 on every double is a whole number.
    whole = F.transform("scaled", lambda x: F.when(F.abs(x) >= _EXACT, x).otherwise(F.floor(x).cast("double")))
    return read.where(fine).select("vec_id", whole.alias("whole"), F.monotonically_increasing_id().alias("row"))


def _lists(column: pa.Array, width: int) -> np.ndarray:
    """The lists as rows of a matrix, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, largest first, from per-batch Gram matrices summed by Spark."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = _lists(b.column(0), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    each = map_batches(vectors.select("whole"), gram, "row int, sums array<double>").select("row", F.posexplode("sums").alias("at", "x"))
    cells = each.groupBy("row", "at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((width, width))
    for c in cells:
        total[c["row"], c["at"]] = c["x"]
    values, turned = np.linalg.eigh(total)
    return turned[:, np.argsort(-values)]


class Best:
    """The k best of each query over the blocks that a task has met.

    ``floors`` are scores that k candidates of the query are known to reach (-inf where unknown). ``formed`` counts the
    products that were formed in full.
    """

    def __init__(self, queries: np.ndarray, ids: np.ndarray, floors: np.ndarray, turn: np.ndarray, k: int):
        self.queries, self.ids, self.turn, self.k = queries, ids, turn, k
        self.floors = floors.astype(np.float64).copy()
        self.lead = min(LEADING, turn.shape[1])
        turned = queries @ turn
        self.length = np.linalg.norm(queries, axis=1)
        self.leading, self.rest = turned[:, : self.lead].copy(), np.linalg.norm(turned[:, self.lead :], axis=1)
        #: query (ascending), vector id, score, its double
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.formed = self.unbound = 0

    def block(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(-np.einsum("ij,ij->i", vectors, vectors), kind="stable")
        vectors, ids = vectors[order], ids[order]
        turned, length = vectors @ self.turn, np.linalg.norm(vectors, axis=1)
        leading, rest = turned[:, : self.lead], np.linalg.norm(turned[:, self.lead :], axis=1)
        large = self.length.max(initial=0) * length.max(initial=0) >= _EXACT
        for at in range(0, len(vectors), STEP_ROWS):
            step = slice(at, at + STEP_ROWS)
            slack = 1e-9 * self.length * length[at] + 1e-6
            alive = np.flatnonzero(self.length * length[at] + slack >= self.floors)
            if not len(alive):
                break  # vectors that follow are shorter still
            candidates = vectors[step], ids[step]
            if not large and self.unbound:
                self.unbound -= 1
                self._whole(alive, *candidates)
                continue
            bound = self.leading[alive] @ leading[step].T + np.outer(self.rest[alive], rest[step])
            bound += slack[alive, None]
            near = bound >= self.floors[alive, None]
            if not large and np.count_nonzero(near) > DENSE * near.size:
                self.unbound = UNBOUND_STEPS
                self._whole(alive, *candidates)
            else:
                self._pairs(*np.nonzero(near), alive, *candidates, large)

    def _whole(self, alive: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        scores = self.queries[alive] @ vectors.T
        self.formed += scores.size
        hit = scores >= self.floors[alive, None]
        rows = np.flatnonzero(hit.any(axis=1))
        if not len(rows):
            return
        hit = hit[rows] & (self.ids[alive[rows], None] != ids)
        if len(ids) > self.k:
            scores = np.where(hit, scores[rows], -np.inf)
            hit &= scores >= np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None]
        else:
            scores = scores[rows]
        row, column = np.nonzero(hit)
        wide = scores[row, column]
        self._add(alive[rows[row]], ids[column], wide.astype(np.int64), wide)

    def _pairs(self, row: np.ndarray, column: np.ndarray, alive: np.ndarray, vectors: np.ndarray, ids: np.ndarray, large: bool) -> None:
        other = self.ids[alive[row]] != ids[column]
        row, column = alive[row[other]], column[other]
        if not len(row):
            return
        self.formed += len(row)
        if large:
            whole: dict[int, list[int]] = {}
            exact = []
            for q, c in zip(row.tolist(), column.tolist(), strict=True):
                if q not in whole:
                    whole[q] = [int(x) for x in self.queries[q]]
                exact.append(sum(int(x) * y for x, y in zip(vectors[c], whole[q], strict=True)))
            wide = np.array([float(s) for s in exact])
            scores = np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in exact], np.int64)
        else:
            wide = np.einsum("ij,ij->i", self.queries[row], vectors[column])
            scores = wide.astype(np.int64)
        hit = wide >= self.floors[row]
        self._add(row[hit], ids[column[hit]], scores[hit], wide[hit])

    def _add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray, wide: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.zeros(len(self.queries), bool)
        touched[row] = True
        old = touched[self.best[0]]
        row, ids, scores, wide = (np.concatenate([b[old], x]) for b, x in zip(self.best, (row, ids, scores, wide), strict=True))
        # Not -scores: the smallest number of 64 bits has no opposite. ~x falls as x rises.
        order = np.lexsort((ids, ~scores, -wide, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = order[place == self.k - 1]
        full = row[place == self.k - 1]
        self.floors[full] = np.maximum(self.floors[full], wide[last])
        kept = place < self.k
        order, row = order[kept], row[kept]
        merged = [np.concatenate([b[~old], x]) for b, x in zip(self.best, (row, ids[order], scores[order], wide[order]), strict=True)]
        self.best = tuple(merged)


_RESULT = "query_id bigint, vec_id bigint, score bigint, wide double"
_RESULT_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _scorer(sent, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, queries, q_ids, floors = sent.value
        groups = [slice(at, at + QUERY_ROWS) for at in range(0, len(queries), QUERY_ROWS)]
        tops = [Best(queries[g], q_ids[g], floors[g], turn, k) for g in groups]

        def score(parts: list[pa.RecordBatch]) -> None:
            vectors = np.concatenate([_lists(p.column(1), turn.shape[0]) for p in parts])
            ids = np.concatenate([p.column(0).to_numpy(zero_copy_only=False) for p in parts])
            for top in tops:
                top.block(vectors, ids)

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(at, BLOCK_ROWS))
                size += held[-1].num_rows
                if size >= BLOCK_ROWS:
                    score(held)
                    held, size = [], 0
        if held:
            score(held)
        for top in tops:
            row, *columns = top.best
            for at in range(0, len(row), BLOCK_ROWS):
                part = slice(at, at + BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(top.ids[row[part]]), *(pa.array(c[part]) for c in columns)], _RESULT_NAMES)

    return work


def need_of(floors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The least length of a vector that can reach the floor; a floor of zero or less can be reached by any."""
    return np.where((floors > 0) & (lengths > 0), floors / np.maximum(lengths, 1e-300) * (1 - 1e-9), np.where(floors > 0, np.inf, -np.inf))


def top_k(
    df: DataFrame, k: int = K, every: int = QUERY_EVERY, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """query_id, rank, vec_id, score for each query: the rows whose id is divisible by ``every``."""
    spark = df.sparkSession
    ship_package(spark)
    with Scratch(spark) as scratch:
        found = _found(df, k, every, vec_id, vector, scale, scratch)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("wide"), F.desc("score"), "vec_id"))
    return (
        found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _banded(rows: DataFrame, value: str, cuts: np.ndarray, most: int) -> DataFrame:
    """rows with their block: bands of the value, highest first, each divided by row so that no block outgrows ``most``."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf(T.LongType())
    def band(x: pd.Series) -> pd.Series:
        return pd.Series(len(sent.value) - np.searchsorted(sent.value, x.to_numpy(), side="right"))

    banded = rows.withColumn("band", band(value))
    counts = banded.groupBy("band").count().toPandas()
    parts = spark.createDataFrame(
        [(int(b), max(1, -(-int(c) // most))) for b, c in zip(counts["band"], counts["count"], strict=True)], "band bigint, parts int"
    )
    return banded.join(F.broadcast(parts), "band").withColumn("block", F.col("band") * (1 << 20) + F.pmod(F.xxhash64("row"), "parts")).drop("band", "parts")


def _cuts(values: DataFrame, parts: int, rows: int) -> np.ndarray:
    """Splitters of the values into so many parts, from a bounded draw by hash."""
    drawn = min(1.0, 64.0 * parts / max(rows, 1))
    chance = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / float(1 << 20)
    sample = np.sort(values.where(chance < drawn).select("value").toPandas()["value"].to_numpy(np.float64))[::-1]
    return np.unique(sample[(np.arange(1, parts) * len(sample)) // parts]) if len(sample) else np.empty(0)


def _scored(vectors: DataFrame, asked: DataFrame, turn: np.ndarray, k: int, scratch: Scratch) -> DataFrame:
    """query_id, vec_id, score, wide: the k best of a round's queries (vec_id, whole, floor) in each task's vectors."""
    got = asked.select("vec_id", "whole", "floor").toArrow().combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in got.columns]
    queries = _lists(columns[1], turn.shape[0])
    floors = columns[2].to_numpy(zero_copy_only=False)
    # Queries of like need stand together, so that a block is skipped by all of a group.
    order = np.argsort(need_of(floors, np.linalg.norm(queries, axis=1)), kind="stable")
    sent = vectors.sparkSession.sparkContext.broadcast((turn, queries[order], columns[0].to_numpy(zero_copy_only=False)[order], floors[order]))
    found = scratch.keep(map_batches(vectors.select("vec_id", "whole"), _scorer(sent, k), _RESULT))
    sent.destroy()
    return found


def _found(df: DataFrame, k: int, every: int, vec_id: str, vector: str, scale: int, scratch: Scratch) -> DataFrame:
    """query_id, vec_id, score, wide: the k best of each query in each task that it went to."""
    spark = df.sparkSession
    vectors = scratch.keep(usable(df, vec_id, vector, scale).withColumn("square", F.aggregate("whole", F.lit(0.0), lambda a, x: a + x * x)))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    rows, asked, width = vectors.agg(F.count("*"), F.count(F.when(is_query, 1)), F.coalesce(F.max(F.size("whole")), F.lit(0))).first()
    if not rows or not asked:
        return spark.createDataFrame([], _RESULT)
    width = max(width, 1)
    turn = rotation(vectors, width)
    cuts = _cuts(vectors.select("row", F.col("square").alias("value")), -(-rows // BLOCK_ROWS), rows)
    seed = F.pmod(F.xxhash64("row"), F.lit(SEED_EVERY)) == 0
    seed = (F.col("square") >= float(cuts[-1])) | seed if len(cuts) else F.lit(True)
    dealt = vectors.withColumn("seed", seed).repartitionByRange(-(-rows // PART_ROWS), F.desc("square"), "row")
    ordered = scratch.keep(dealt.sortWithinPartitions(F.desc("square")))
    scratch.drop(vectors)
    queries = ordered.where(is_query).select("row", "vec_id", "whole", "square")

    most = max(1, ROUND_BYTES // (8 * width))
    parts = -(-asked // most)
    start = queries.withColumn("floor", F.lit(float("-inf")))
    turns = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts))
    found = [_scored(ordered.where("seed"), start.where(turns == i), turn, k, scratch) for i in range(parts)]
    if not len(cuts):
        return _union(found)
    # The k-th best of the first pass, over all rows of a query's id.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("wide")))
    floor = _union(found).withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("wide").alias("floor"))
    known = queries.join(floor, "vec_id", "left").fillna(float("-inf"), ["floor"])
    need = F.when(F.col("floor") > 0, F.try_divide("floor", F.sqrt("square"))).otherwise(F.lit(0.0))
    known = scratch.keep(known.withColumn("need", F.coalesce(need, F.lit(0.0))))
    levels = _cuts(known.select("row", F.col("need").alias("value")), min(parts, NEED_LEVELS), asked)
    rounds = scratch.keep(_banded(known, "need", levels, 2 * most))
    for r in rounds.groupBy("block").agg(F.min("need").alias("least")).orderBy("block").collect():
        # The margin covers the rounding of lengths and squares.
        reached = ordered.where(~F.col("seed") & (F.col("square") >= r["least"] ** 2 * (1 - 1e-6)))
        found.append(_scored(reached, rounds.where(F.col("block") == r["block"]), turn, k, scratch))
    scratch.drop(ordered, known, rounds)
    return _union(found)


def _union(tables: list[DataFrame]) -> DataFrame:
    first, *others = tables
    for other in others:
        first = first.unionByName(other)
    return first


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
