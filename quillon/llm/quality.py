"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated
probabilities.

A fitting sample of at most ``FIT_ROWS`` labelled rows is chosen by hash (rows whose checksum marks them as held out are
never in it). From its whole texts come the ``VOCABULARY`` most widespread words and word shapes, and a vector for each: the
sum of the sparse random index vectors of its neighbours, normalised, plus its own index vector. A document's words
and shapes are pooled to mean vectors, with three pooled scalars (how concentrated the words are, how often a word repeats its
neighbour, how many words there are). The network has one hidden layer; a fifth of the sample is kept
from its training to fit the temperature. What reaches the driver is bounded by ``FIT_ROWS`` feature rows and one
vocabulary-sized sum, in rows of ``SUM_ROWS`` vectors; what is broadcast is bounded by the vocabulary.

Scores read the text alone. Defined cases: a null or empty text has zero vectors and gets the score of those; a null id is
held out; repeated labels of an id count as their mean, rounded up at one half; null labels are ignored; without
two classes in the sample every score is the smoothed share of label 1; an empty table gives an empty result; other
columns are ignored. Texts and words of any length are read whole; a word of more than ``LONGEST_WORD`` characters goes by
its checksum and length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.batches import kept_names, map_batches
from quillon.llm.worker import LONGEST_KEPT, claim, entry_bytes
from quillon.session import durable, table, tidy

FIT_ROWS = 6_000
FIT_PARTS = 4
#: Vectors in a row of sums (64 KB): the driver's JVM copies a row several times, and rows of megabytes would make its heap grow.
SUM_ROWS = 128
VOCABULARY = 16_384
DIMENSIONS = 128
NONZERO = 8
HIDDEN = 64
EPOCHS = 60
BATCH = 256
RATE = 2e-3
DECAY = 1e-2
THRESHOLD = 0.3
#: Longer words and shapes are named by their checksum, longer shapes by their kinds.
LONGEST_WORD = 40
LONGEST_SHAPE = 12
#: Bytes of words that a Python worker keeps.
CACHE_BYTES = 48 << 20
SCALARS = 3
#: The few scalars would drown among the many coordinates of the vectors.
SCALAR_GAIN = 3.0
OUTSIDE = 1 << 32
PAIRS_AT_ONCE = 500_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def token(word: str) -> str:
    """The word itself, or, if it is long, a name of fixed length for it."""
    return word if len(word) <= LONGEST_WORD else f"\n#{zlib.crc32(word.encode('utf-8', 'replace')):08x}{len(word)}"


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, other characters as they are, runs of one kind collapsed; marked as a shape.

    The whole word is read. A shape of many runs is named by its kinds and the size of their number.
    """
    out = []
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != kind:
            out.append(kind)
    if len(out) <= LONGEST_SHAPE:
        return "\n" + "".join(out)
    return token("\n*" + "".join(sorted(set(out))) + str(len(out).bit_length()))


def index_vectors(tokens: list[str]) -> np.ndarray:
    """Sparse random vectors that depend on the token alone."""
    out = np.zeros((len(tokens), DIMENSIONS), np.float32)
    for row, token in enumerate(tokens):
        rng = np.random.Generator(np.random.PCG64(zlib.crc32(token.encode("utf-8", "replace"))))
        at = rng.choice(DIMENSIONS, NONZERO, replace=False)
        out[row, at] = rng.choice(np.array([-1.0, 1.0], np.float32), NONZERO) / np.sqrt(NONZERO)
    return out


class TokenIds(dict):
    """word -> word number << 20 | shape number.

    Shapes outside the vocabulary are 0; words outside it keep a number of their own over ``OUTSIDE``, so that repeats show.
    """

    def __init__(self, tokens: list[str]):
        super().__init__()
        self.number = {t: i + 1 for i, t in enumerate(tokens)}
        self.held = 0

    def __missing__(self, word: str) -> int:
        own = self.number.get(token(word)) or OUTSIDE + zlib.crc32(word.encode("utf-8", "replace"))
        both = own << 20 | self.number.get(shape(word), 0)
        if len(word) <= LONGEST_KEPT:
            self.held += entry_bytes(word) + 32
            if self.held > CACHE_BYTES:
                self.forget()
            self[word] = both
        return both

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split() if text else []
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return both >> 20, both & 0xFFFFF


def pooled(words: np.ndarray, shapes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, mean shape vector and the scalars of one document."""
    out = np.zeros(2 * DIMENSIONS + SCALARS, np.float32)
    n = len(words)
    if not n:
        return out
    for part, ids in enumerate((words, shapes)):
        seen, counts = np.unique(ids, return_counts=True)
        share = (counts / n).astype(np.float32)
        out[part * DIMENSIONS : (part + 1) * DIMENSIONS] = share @ vectors[np.where(seen < OUTSIDE, seen, 0)]
        if not part:
            out[-3] = float((share**2).sum())
    out[-2] = float((words[1:] == words[:-1]).sum()) / n
    out[-1] = np.log1p(n)
    return out


@dataclass
class Model:
    tokens: list[str]
    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    weights: tuple[np.ndarray, ...]
    temperature: float
    prior: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.prior)
        return sigmoid(forward(self.weights, (features - self.centre) / self.spread)[1] / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -60, 60)))


def forward(weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = weights
    hidden = np.maximum(x @ w1 + b1, 0)
    return hidden, hidden @ w2 + b2


def train(x: np.ndarray, y: np.ndarray, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Two layers by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    weights = [
        rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN).astype(np.float32),
        np.zeros((), np.float32),
    ]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            hidden, logit = forward(weights, x[rows])
            error = ((sigmoid(logit) - y[rows]) / len(rows)).astype(np.float32)
            back = np.outer(error, weights[2]) * (hidden > 0)
            slopes = [x[rows].T @ back + DECAY * weights[0], back.sum(0), hidden.T @ error + DECAY * weights[2], error.sum()]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[i] = (weights[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)).astype(np.float32)
    return tuple(weights)


def fit_temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, on a fixed grid."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))

    def loss(t: float) -> float:
        p = np.clip(sigmoid(logit / t), 1e-9, 1 - 1e-9)
        return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    return float(min(grid, key=loss))


def fitting_sample(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts that are not held out: number (by hash), text, label."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = known.withColumn("number", F.xxhash64("doc_id")).orderBy("number", "doc_id").limit(rows)
    once = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Repeated rows of one id could outgrow the bound, so one of them is taken.
    return once.groupBy("doc_id", "number", "label").agg(F.max("text").alias("text"))


def _vocabulary(sample: DataFrame) -> list[str]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = set((text or "").split())
                seen.update({token(w) for w in words})
                seen.update({shape(w) for w in words})
        items = list(seen.items())
        for at in range(0, len(items), 20_000):
            part = items[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part]), pa.array([n for _, n in part], pa.int64())], ["token", "n"])

    counted = map_batches(sample.select("text"), work, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return [r.token for r in counted.where(F.col("n") > 1).orderBy(F.desc("n"), "token").limit(VOCABULARY).collect()]


def add_context(total: np.ndarray, sequences: list[np.ndarray], own: np.ndarray) -> None:
    """Add to each token's row the index vectors of its neighbours in the sequences, a nonzero coordinate at a time."""
    rows, size = own.shape
    at = np.zeros((rows, NONZERO), np.int64)
    at[1:] = np.nonzero(own[1:])[1].reshape(-1, NONZERO)
    sign = np.take_along_axis(own, at, axis=1)
    pairs = np.concatenate([np.stack([x[1:], x[:-1]]) for x in sequences], axis=1)
    keys, times = np.unique(np.concatenate([pairs[0] * rows + pairs[1], pairs[1] * rows + pairs[0]]), return_counts=True)
    for start in range(0, len(keys), PAIRS_AT_ONCE):
        token, beside = np.divmod(keys[start : start + PAIRS_AT_ONCE], rows)
        cells = (token[:, None] * size + at[beside]).ravel()
        weights = (sign[beside] * times[start : start + PAIRS_AT_ONCE, None]).ravel()
        total += np.bincount(cells, weights, rows * size).reshape(rows, size)


def _context(sample: DataFrame, tokens: list[str], own: np.ndarray) -> np.ndarray:
    """For each token the sum of its neighbours' index vectors over the sample: words beside words, shapes beside shapes."""
    sent = sample.sparkSession.sparkContext.broadcast((tokens, own))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, own = sent.value
        ids, total = ids_of(tokens), np.zeros(own.shape)
        for batch in batches:
            found = [np.where(y < OUTSIDE, y, 0) for t in batch.column(0).to_pylist() for y in ids.of(t)]
            if found:
                add_context(total, found, own)
        part = TaskContext.get().partitionId()
        for at in range(0, len(total), SUM_ROWS):
            sums = total[at : at + SUM_ROWS].astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part], pa.int32()), pa.array([sums], pa.binary())], ["at", "part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sum(np.frombuffer(p["sums"], "<f4") for p in parts).astype("<f4").tobytes() for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["at", "sums"])

    # Few tasks, each with one vocabulary-sized sum, whatever the number of partitions of the sample; added up on the executors.
    parts = map_batches(sample.select("text").coalesce(FIT_PARTS), work, "at int, part int, sums binary")
    beside = parts.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("part", "sums"))).alias("parts"))
    total = np.zeros_like(own)
    for row in map_batches(beside, add, "at int, sums binary").collect():
        total[row["at"] : row["at"] + SUM_ROWS] = np.frombuffer(bytes(row.sums), "<f4").reshape(-1, own.shape[1])
    sent.destroy()
    return total


_IDS: dict[int, TokenIds] = {}


def _forget() -> None:
    for ids in _IDS.values():
        ids.forget()
    _IDS.clear()


def ids_of(tokens: list[str]) -> TokenIds:
    """The table of the vocabulary in use, one per Python worker, which outlives a task."""
    claim("quality", _forget)
    mark = hash(tuple(tokens))
    if mark not in _IDS:
        _forget()
        _IDS[mark] = TokenIds(tokens)
    return _IDS[mark]


def features(model: Model, rows: list[str | None], ids: TokenIds) -> np.ndarray:
    return np.stack([pooled(*ids.of(t), model.vectors) for t in rows])


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    sample = durable(fitting_sample(documents, labels, rows))
    tokens = _vocabulary(sample)
    own = np.concatenate([np.zeros((1, DIMENSIONS), np.float32), index_vectors(tokens)])
    context = _context(sample, tokens, own)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = own + context / np.where(length > 0, length, 1)
    width = 2 * DIMENSIONS + SCALARS
    model = Model(tokens, vectors.astype(np.float32), np.zeros(width, np.float32), np.ones(width, np.float32), (), 1.0, 0.5)
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(sent.value.tokens)
        for batch in batches:
            x = features(sent.value, batch.column(2).to_pylist(), ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], ["number", "label", "x"]
            )

    got = map_batches(sample.select("number", "label", "text"), work, "number bigint, label int, x binary").collect()
    sent.destroy()
    tidy(sample.sparkSession)
    got.sort(key=lambda r: r.number)
    y = np.array([r.label for r in got], np.float64)
    model.prior = float((y.sum() + 1) / (len(y) + 2))
    if len(set(y)) < 2:
        return model
    x = np.stack([np.frombuffer(bytes(r.x), "<f4") for r in got])
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart = np.zeros(len(y), bool)
    model.centre, model.spread = x[~apart].mean(0), x[~apart].std(0) + 1e-3
    model.spread[-SCALARS:] /= SCALAR_GAIN
    scaled = (x - model.centre) / model.spread
    model.weights = train(scaled[~apart], y[~apart])
    if apart.any():
        model.temperature = fit_temperature(forward(model.weights, scaled[apart])[1], y[apart])
    return model


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and the probability of label 1 as ``score``; a kept ``score`` comes out as ``input_score``."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    read = documents.select(*(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))
    names = read.columns[:-1]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(sent.value.tokens)
        for batch in batches:
            if not batch.num_rows:
                continue
            p = sent.value.probability(features(sent.value, batch.column(len(names)).to_pylist(), ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(p, pa.float64())], [*names, "score"])

    return map_batches(read, work, f"{schema}, score double").toDF(*kept_names(keep, ("score",)), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
