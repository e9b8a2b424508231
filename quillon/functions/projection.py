"""Hashed projection of a text to a fixed number of signed buckets, normalised.

Each of the first 256 words adds to three buckets at weights 1, 0.75 and 0.5, and with the word before it to one at 0.35; its
hash depends on its place.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS, MOST_WORDS = 384, 256
# Weight, salt of the bucket and salt of the sign.
WORD_PARTS = ((1.0, 0x11, 0x44), (0.75, 0x22, 0x55), (0.5, 0x33, 0x66))
PAIR_PART = (0.35, 0x77, 0x88)
WORD_MARK = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[A-Za-z0-9_\x80-\xff]+")
_MASK = (1 << 64) - 1


def words(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else (text or "").encode()
    return [w.lower() for w in _WORD.findall(raw)][:MOST_WORDS]


def equal_words(a: str | bytes | None, b: str | bytes | None) -> bool:
    """Whether two texts have the same words, whatever the case and what stands between them."""
    return words(a) == words(b)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(found: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of each word, marked so that none is 0 for the empty word; letter by letter over all words at once."""
    longest = max(map(len, found), default=0)
    h = np.full(len(found), 0xCBF29CE484222325, np.uint64)
    if longest:
        lengths = np.array([len(w) for w in found])
        for at in range(longest):
            live = np.flatnonzero(lengths > at)
            h[live] = (h[live] ^ np.array([found[i][at] for i in live], np.uint64)) * np.uint64(0x100000001B3)
    return h ^ np.uint64(WORD_MARK)


def _add(out: np.ndarray, hashes: np.ndarray, weight: float, bucket: int, sign: int) -> None:
    at = (_mixed(hashes ^ np.uint64(bucket)) % np.uint64(DIMENSIONS)).astype(np.int64)
    np.add.at(out, at, np.where(_mixed(hashes ^ np.uint64(sign)) & np.uint64(1), -weight, weight))


def project(text: str | bytes | None) -> np.ndarray:
    out, h = np.zeros(DIMENSIONS), word_hashes(words(text))
    placed = _mixed(h ^ (np.arange(len(h), dtype=np.uint64) << np.uint64(32)))
    for part in WORD_PARTS:
        _add(out, placed, *part)
    turned = (h[:-1] << np.uint64(17)) | (h[:-1] >> np.uint64(47))
    _add(out, _mixed(turned ^ h[1:]), *PAIR_PART)
    length = np.linalg.norm(out)
    return out / length if length > 1e-12 else np.zeros(DIMENSIONS)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Of two projections; below zero counts as zero."""
    return float(min(1.0, max(0.0, a @ b)))


def projection(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def work(s: pd.Series) -> pd.Series:
        known = {t: project(t) for t in set(s)}
        return s.map(known.__getitem__)

    return work(text)


def similarity(a: Column, b: Column) -> Column:
    """The cosine of two texts' projections, at least 0: vectors.cosine() of both, which stay in the worker one pair at a time."""

    @F.pandas_udf("double")
    def work(x: pd.Series, y: pd.Series) -> pd.Series:
        known = {pair: _cosine(*map(project, pair)) for pair in set(zip(x, y, strict=True))}
        return pd.Series([known[pair] for pair in zip(x, y, strict=True)], dtype=float)

    return work(a, b)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    """As vectors.cosine() adds: from first to last, so that no rounding differs."""
    dot = lambda x, y: float(np.cumsum(x * y)[-1])
    lengths = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
    return max(0.0, float(dot(a, b) / lengths)) if lengths else 0.0
