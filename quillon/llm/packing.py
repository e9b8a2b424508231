"""Hierarchical multi-length packing of tokenised documents.

A document's ids (with the end id 0) are cut into full windows of the longest tier; what remains is routed to the shortest
tier that holds it. Tiers are packed from long to short: a window takes the longest fragment of its tier, then the longest
fragments of its own and shorter tiers that fit, and a last gap is filled by cutting the head off a longer fragment, whose
rest goes back to the tier it now belongs to. So every window is full but those at the very end of an input partition,
which are cut to descending powers of two. Windows of one tier are dealt to step groups of equal tokens, back and forth in
the order of their attention cost.

Each task packs its own input partition, a bounded block of documents at a time (a fragment that is left over goes on to the
next block), so nothing is shuffled, no task sees more than its partition, and a task that is run again on the same
partition gives the same windows.

The tokenizer's pieces are cut at single spaces between non-spaces, where the pre-tokenizer's pattern always starts a new
token, and the ids of a piece are kept for the next time it is met. New pieces of letters alone are encoded many at a time, as
words of one text, which is cut again where an id begins with a space.

Defined cases: a null text counts as empty (the end id alone); special strings in a text become their ids; repeated rows and
null or repeated ids are packed row by row; an empty table gives an empty result; other columns are ignored. Texts of any
length are packed whole.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.batches import map_batches
from quillon.llm.worker import LONGEST_KEPT, claim, entry_bytes
from quillon.session import table

TIERS = (1024, 512, 256, 128)
#: Tokens of the documents that are packed together, at most by one document more.
BLOCK_TOKENS = 1_000_000
#: Tokens of a step group.
STEP_TOKENS = 16_384
END = (0).to_bytes(4, "little")
#: Bytes of pieces and their ids that a Python worker keeps.
CACHE_BYTES = 144 << 20
#: Characters of texts, and pieces, that are encoded at a time: cut texts and the library's own results are many times larger.
ENCODE_CHARACTERS = 256 << 10
ASK_PIECES = 16_384
#: Words that are encoded as one text.
ASK_WORDS = 64

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint,"
    " tier int, step_group bigint"
)

_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_TWO_SPACES = re.compile(r"\s\s")
#: Pieces of these letters, signs and single line ends the pattern parts where the kind changes, whatever stands beside.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"(?=[^\n])(?:[{_LETTERS}]++|[{_SIGNS}]++|\n(?=[^\n]))++")
_PART = re.compile(rf"[{_LETTERS}]+|[{_SIGNS}]+|\n")
_SPECIAL = "<|"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceIds:
    """Ids (little-endian unsigned 32-bit) of the pieces of texts, by a byte-level tokenizer file of the library.

    Pieces are forgotten, all together, when they take more than ``cache_bytes``; long ones are never kept beyond their batch.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(True)
        #: Whether an id begins with a space; byte-level files write Ġ for it.
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.long: list[tuple[dict[str, bytes], str]] = []
        self.held = 0
        self.cache_bytes = cache_bytes

    def forget(self) -> None:
        for kept in (self.first, self.later, self.bare):
            kept.clear()
        self.long.clear()
        self.held = 0

    def _keep(self, kept: dict[str, bytes], piece: str, ids: bytes) -> None:
        kept[piece] = ids
        if len(piece) > LONGEST_KEPT:
            self.long.append((kept, piece))
        else:
            self.held += entry_bytes(piece) + len(ids)

    def _ask(self, kept: dict[str, bytes], lead: str, new: list[str]) -> None:
        for at in range(0, len(new), ASK_PIECES):
            part = new[at : at + ASK_PIECES]
            got = self.tokenizer.encode_batch_fast([lead + p for p in part], add_special_tokens=False)
            for p, x in zip(part, got, strict=True):
                self._keep(kept, p, array("I", x.ids).tobytes())

    def _ask_words(self, kept: dict[str, bytes], words: list[str]) -> None:
        """_ask() with a space before each, for words of letters alone."""
        for at in range(0, len(words), ASK_PIECES):
            part = words[at : at + ASK_PIECES]
            groups = [part[i : i + ASK_WORDS] for i in range(0, len(part), ASK_WORDS)]
            got = self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)
            for g, x in zip(groups, got, strict=True):
                ids = array("I", x.ids).tobytes()
                starts = np.flatnonzero(self.spaced[np.frombuffer(ids, np.uint32)])
                if len(starts) != len(g) or starts[0]:
                    self._ask(kept, " ", g)
                    continue
                kept.update(zip(g, [ids[a:b] for a, b in pairwise([*(4 * starts).tolist(), len(ids)])], strict=True))
                self.held += sum(map(entry_bytes, g)) + len(ids)

    def _learn(self, kept: dict[str, bytes], lead: str, pieces: set[str]) -> None:
        """Only the first part of a plain piece has the lead, a space, before it."""
        new = pieces.difference(kept)
        whole, parted, bare = set(), [], set()
        if lead:
            words = [p for p in new if p.isalpha() and len(p) <= LONGEST_KEPT]
            self._ask_words(kept, words)
            new.difference_update(words)
        for p in new:
            if _PLAIN.fullmatch(p) and _SPECIAL not in p and len(parts := _PART.findall(p)) > 1:
                parted.append((p, parts))
                whole.add(parts[0])
                bare.update(parts[1:])
            else:
                whole.add(p)
        self._ask(kept, lead, list(whole.difference(kept)))
        self._ask(self.bare, "", list(bare.difference(self.bare)))
        for p, parts in parted:
            self._keep(kept, p, kept[parts[0]] + b"".join([self.bare[x] for x in parts[1:]]))

    def encode(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= ENCODE_CHARACTERS):
                size += len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.held > self.cache_bytes:
            self.forget()
        cut = [_INNER_SPACE.split(t) if _TWO_SPACES.search(t) else t.split(" ") for t in texts]
        first = [x[0] for x in cut]
        for x in cut:
            del x[0]
        self._learn(self.first, "", set(first))
        self._learn(self.later, " ", set(chain.from_iterable(cut)))
        later = self.later.__getitem__
        ids = [self.first[f] + b"".join(map(later, x)) for f, x in zip(first, cut, strict=True)]
        for kept, piece in self.long:
            kept.pop(piece, None)
        self.long.clear()
        return ids


@dataclass(slots=True)
class Document:
    doc_id: int | None
    ids: bytes
    tokens: int


#: A fragment: (document, start, length).
Fragment = tuple[Document, int, int]


class Pool:
    """Fragments by length; equal lengths are taken in the order in which they came."""

    def __init__(self):
        self.by_length: dict[int, list[Fragment]] = {}
        self.lengths: list[int] = []

    def add(self, fragment: Fragment) -> None:
        have = self.by_length.get(fragment[2])
        if have:
            have.append(fragment)
        else:
            self.by_length[fragment[2]] = [fragment]
            insort(self.lengths, fragment[2])

    def _take(self, at: int) -> Fragment:
        length = self.lengths[at]
        have = self.by_length[length]
        fragment = have.pop()
        if not have:
            del self.by_length[length], self.lengths[at]
        return fragment

    def longest(self, most: int) -> Fragment | None:
        """The longest fragment of at most so many tokens."""
        at = bisect_right(self.lengths, most) - 1
        return self._take(at) if at >= 0 else None

    def shortest_over(self, least: int) -> Fragment | None:
        at = bisect_right(self.lengths, least)
        return self._take(at) if at < len(self.lengths) else None


def fill(pool: Pool, tier: int, least: int) -> Iterator[list[Fragment]]:
    """Windows of a tier while it has a fragment longer than ``least``; the last one may be short."""
    while pool.lengths and pool.lengths[bisect_right(pool.lengths, tier) - 1] > least:
        window, gap = [], tier
        while gap and (got := pool.longest(gap)):
            window.append(got)
            gap -= got[2]
        if gap and (got := pool.shortest_over(gap)):
            doc, start, length = got
            window.append((doc, start, gap))
            pool.add((doc, start + gap, length - gap))
        yield window


def tail_windows(fragments: list[Fragment], tiers: tuple[int, ...]) -> Iterator[tuple[int, list[Fragment]]]:
    """What is left at the end, cut to descending powers of two."""
    left = sum(x[2] for x in fragments)
    queue = list(fragments)
    while left:
        size = min(tiers[0], 1 << (left.bit_length() - 1))
        window, gap = [], size
        while gap:
            doc, start, length = queue.pop(0)
            taken = min(gap, length)
            window.append((doc, start, taken))
            if taken < length:
                queue.insert(0, (doc, start + taken, length - taken))
            gap -= taken
        left -= size
        yield size, window


@dataclass
class Packer:
    """Packs one input partition; ``base`` makes its sequence and group numbers unlike those of other partitions."""

    base: int
    tiers: tuple[int, ...] = TIERS
    step_tokens: int = STEP_TOKENS
    sequences: int = 0
    groups: int = 0
    left: list[Fragment] = field(default_factory=list)

    def block(self, documents: list[Document]) -> Iterator[tuple]:
        longest = self.tiers[0]
        pool, full = Pool(), []
        for fragment in self.left:
            pool.add(fragment)
        self.left = []
        for doc in documents:
            whole = doc.tokens - doc.tokens % longest
            full += ([(doc, start, longest)] for start in range(0, whole, longest))
            if doc.tokens > whole:
                pool.add((doc, whole, doc.tokens - whole))
        windows = {t: [] for t in self.tiers}
        windows[longest] = full
        for tier, shorter in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            for window in fill(pool, tier, shorter):
                if sum(x[2] for x in window) == tier:
                    windows[tier].append(window)
                else:
                    self.left += window
        for tier, made in windows.items():
            yield from self._numbered(tier, made)

    def end(self) -> Iterator[tuple]:
        for size, window in tail_windows(self.left, self.tiers):
            yield from self._numbered(size, [window])
        self.left = []

    def _numbered(self, tier: int, windows: list[list[Fragment]]) -> Iterator[tuple]:
        groups = -(-len(windows) * tier // self.step_tokens)
        by_cost = sorted(range(len(windows)), key=lambda i: -sum(x[2] ** 2 for x in windows[i]))
        dealt = {}
        for rank, i in enumerate(by_cost):
            turn, at = divmod(rank, groups)
            dealt[i] = self.base + self.groups + (at if turn % 2 == 0 else groups - 1 - at)
        self.groups += groups
        for i, window in enumerate(windows):
            offset = 0
            for doc, start, length in window:
                yield doc.doc_id, start, length, doc.ids[4 * start : 4 * (start + length)], doc.tokens, self.base + self.sequences, offset, tier, dealt[i]
                offset += length
            self.sequences += 1


_ENCODERS: dict[str, PieceIds] = {}


def _forget() -> None:
    for encoder in _ENCODERS.values():
        encoder.forget()
    _ENCODERS.clear()


def encoder_of(path: str, cache_bytes: int = CACHE_BYTES) -> PieceIds:
    """One encoder per Python worker: workers import this module, so what it holds outlives a task."""
    claim("packing", _forget)
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceIds(path)
    _ENCODERS[path].cache_bytes = cache_bytes
    return _ENCODERS[path]


_NAMES = [x.split()[0] for x in SCHEMA.split(",")]
_TYPES = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(",")]


def _rows(pieces: Iterator[tuple], most: int = 2048) -> Iterator[pa.RecordBatch]:
    rows = []
    for piece in pieces:
        rows.append(piece)
        if len(rows) == most:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def pack(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    cache_bytes: int = CACHE_BYTES,
) -> DataFrame:
    """One row per piece of a document in a sequence; sequences are full windows of a tier or a power of two.

    ``cache_bytes`` bounds the pieces that a Python worker keeps; it never changes a result.
    """
    path = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, cache_bytes)
        packer = Packer(TaskContext.get().partitionId() << 40, tiers)
        block, tokens = [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                doc = Document(i, ids + END, len(ids) // 4 + 1)
                block.append(doc)
                tokens += doc.tokens
            if tokens >= BLOCK_TOKENS:
                yield from _rows(packer.block(block))
                block, tokens = [], 0
        yield from _rows(packer.block(block))
        yield from _rows(packer.end())

    read = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(read, work, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
