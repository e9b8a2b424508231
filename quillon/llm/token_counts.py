"""Token counts with the whole-token shortcut.

Which words encode alone as one token is proved once, on the driver, by doing the merges of every vocabulary string; the
set (bounded by the vocabulary) goes to the workers. A pre-token in the set counts one; only the rest is merged. Counts
of space-separated pieces are kept per worker, up to a fixed number of bytes.

Defined cases: a null text counts as empty (no tokens); special strings inside a text count as one token each; repeated
rows and null or repeated ids give a row each; an empty table gives an empty result; other columns are ignored. Texts of
any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import word_bpe
from quillon.llm.batches import map_batches
from quillon.llm.worker import LONGEST_KEPT, claim, entry_bytes
from quillon.session import table

LIMIT_TOKENS = 2048

_COUNTERS: dict[str, "PieceCounts"] = {}


class PieceCounts(dict):
    """Tokens of a piece; a piece that is not yet known is cut into words, and words not in ``whole`` are merged.

    Pieces and words are forgotten when they take more than ``word_bpe.CACHE_BYTES``; long ones are never kept.
    """

    def __init__(self, bpe: word_bpe.WordBpe, whole: frozenset[str]):
        super().__init__()
        self.bpe, self.whole, self.words, self.held = bpe, whole, {}, 0

    def _keep(self, kept: dict[str, int], key: str, n: int) -> int:
        if len(key) <= LONGEST_KEPT:
            self.held += entry_bytes(key)
            kept[key] = n
        return n

    def word(self, word: str) -> int:
        if word in self.whole or word in self.bpe.special:
            return 1
        if (n := self.words.get(word)) is None:
            n = self._keep(self.words, word, len(self.bpe.merged(self.bpe.symbols(word))))
        return n

    def __missing__(self, piece: str) -> int:
        n = sum(map(self.word, self.bpe.words(piece)))
        if self.held > word_bpe.CACHE_BYTES:
            self.forget()
        return self._keep(self, piece, n)

    def forget(self) -> None:
        self.clear()
        self.words.clear()
        self.held = 0


def _forget() -> None:
    for counts in _COUNTERS.values():
        counts.forget()
    _COUNTERS.clear()


def counts_of(path: str, whole: frozenset[str]) -> PieceCounts:
    """One table per Python worker: workers import this module, so what it holds outlives a task."""
    claim("token_counts", _forget)
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounts(word_bpe.load(path), whole)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens per row."""
    path = path or word_bpe.default_path()
    whole = df.sparkSession.sparkContext.broadcast(word_bpe.load(path).whole_tokens())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(path, whole.value)
        for batch in batches:
            n = [sum(map(counts.__getitem__, t.split(" "))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    read = df.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    return map_batches(read, work, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT_TOKENS)
