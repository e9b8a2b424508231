"""BPE encoding and decoding with a pair occurrence index.

The words of a batch of texts that are not yet known are laid out in one array. An index maps each pair of neighbours to
all of its positions in that array; active ranks are taken in ascending order, a rank's positions are merged from left to
right, and only the lists of the pairs that appear beside a merge are updated. Words do not touch, so one pass over the
array does what a pass over each word would do. Decoding joins the token strings by spaces, which is what the file asks
for (it names no decoder).

Defined cases: a null text counts as empty (no ids, empty decoded text); special strings in a text become their ids;
repeated rows and null or repeated ids give a row each; an empty table gives an empty result; other columns are ignored.
Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import word_bpe
from quillon.llm.batches import map_batches
from quillon.llm.worker import LONGEST_KEPT, claim, entry_bytes
from quillon.session import table

_CODECS: dict[str, "Codec"] = {}


def merge_all(words: list[list[int]], merges: dict[tuple[int, int], tuple[int, int]]) -> list[list[int]]:
    """The tokens of each word, by one index of pair positions over all words."""
    ids: list[int] = []
    after: list[int] = []
    before: list[int] = []
    starts: list[int] = []
    where: dict[tuple[int, int], list[int]] = defaultdict(list)
    for word in words:
        first, last = len(ids), len(ids) + len(word) - 1
        starts.append(first)
        ids += word
        after += [*range(first + 1, last + 1), -1]
        before += [-1, *range(first, last)]
        for i in range(first, last):
            where[ids[i], ids[i + 1]].append(i)
    active = [(merges[p][0], p) for p in where if p in merges]
    heapq.heapify(active)
    while active:
        _, pair = heapq.heappop(active)
        positions = where.pop(pair, None)
        if positions is None:
            continue
        a, b = pair
        new = merges[pair][1]
        positions.sort()
        for i in positions:
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # an earlier merge took one of the two
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                _note(where, active, merges, (new, ids[k]), i)
            h = before[i]
            if h >= 0:
                _note(where, active, merges, (ids[h], new), h)
    out = []
    for first in starts:
        word, i = [], first
        while i >= 0:
            word.append(ids[i])
            i = after[i]
        out.append(word)
    return out


def _note(where, active, merges, pair, position) -> None:
    if pair in merges:
        if pair not in where:
            heapq.heappush(active, (merges[pair][0], pair))
        where[pair].append(position)


class Codec:
    """Ids (little-endian unsigned 32-bit) and decoded bytes of the pieces met so far.

    Pieces and words are forgotten when ids and decoded text take more than ``word_bpe.CACHE_BYTES`` each; long ones go after their batch.
    """

    def __init__(self, bpe: word_bpe.WordBpe):
        self.bpe = bpe
        self.words: dict[str, list[int]] = {}
        self.ids: dict[str, bytes] = {}
        self.said: dict[str, bytes] = {}
        self.long: list[str] = []
        self.held = 0

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.bpe.strings.__getitem__, ids))

    def forget(self) -> None:
        for kept in (self.words, self.ids, self.said, self.long):
            kept.clear()
        self.held = 0

    def _weigh(self, key: str, more: int) -> None:
        if len(key) > LONGEST_KEPT:
            self.long.append(key)
        else:
            self.held += entry_bytes(key) + more

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces that are not yet known, all their new words at once."""
        if self.held > 2 * word_bpe.CACHE_BYTES:
            self.forget()
        cut = {p: self.bpe.words(p) for p in pieces if p not in self.ids}
        new = list({w for words in cut.values() for w in words if w not in self.words})
        for w in new:
            if w in self.bpe.special:
                self.words[w] = [self.bpe.special[w]]
        new = [w for w in new if w not in self.words]
        for w, ids in zip(new, merge_all([self.bpe.symbols(w) for w in new], self.bpe.merges), strict=True):
            self.words[w] = ids
            self._weigh(w, 56 + 8 * len(ids))
        for piece, words in cut.items():
            ids = [i for w in words for i in self.words[w]]
            self.ids[piece] = struct.pack(f"<{len(ids)}I", *ids)
            said = self.said[piece] = self.decode(ids).encode()
            self._weigh(piece, 150 + len(self.ids[piece]) + len(said))

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        cut = [t.split(" ") for t in texts]
        self.learn({p for pieces in cut for p in pieces})
        ids, said = self.ids.__getitem__, self.said.__getitem__
        out = [(b"".join(map(ids, pieces)), b" ".join(filter(None, map(said, pieces)))) for pieces in cut]
        for key in self.long:
            for kept in (self.words, self.ids, self.said):
                kept.pop(key, None)
        self.long.clear()
        return out


def _forget() -> None:
    for codec in _CODECS.values():
        codec.forget()
    _CODECS.clear()


def codec_of(path: str) -> Codec:
    """One codec per Python worker: workers import this module, so what it holds outlives a task."""
    claim("bpe_codec", _forget)
    if path not in _CODECS:
        _CODECS[path] = Codec(word_bpe.load(path))
    return _CODECS[path]


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and the text decoded from them, per row."""
    path = path or word_bpe.default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            done = codec.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x for x, _ in done], pa.binary()),
                    pa.array([x for _, x in done], pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "ids", "decoded"],
            )

    read = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(read, work, "doc_id bigint, ids binary, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
