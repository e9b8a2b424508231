"""The score of an answer against a reference text and a question: lexical blend, contrast and tie slots.

The pieces that depend on token positions run in one Arrow function over batches; tables of words come from
quillon.functions.tables. Word vectors are not part of this build, so soft credit is nil.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import facts, projection
from quillon.functions.tables import AXES, NEGATORS, NUMERALS, SCALES, STOPWORDS

_WORD = rb"[A-Za-z0-9\x80-\xff]"
_TOKEN = re.compile(rb"(?:%s|(?<=[0-9])[.,](?=[0-9]))+" % _WORD)
_BOUNDARY = re.compile(rb"[.,;!?:]")
_ACRONYM = re.compile(rb"[A-Z]{2,4}")
_RUNS = re.compile(rb"[^A-Za-z0-9\x80-\xff]+")
MOST_TOKENS = 2048
MOST_GRAM_BYTES = 65_536
REACH = 4
MOST_TERMS, K1, B = 256, 1.5, 0.75

_STOP = frozenset(w.encode() for w in STOPWORDS)
_NEG = frozenset(w.encode() for w in NEGATORS)
_NUMERALS = {w.encode(): d.encode() for w, d in NUMERALS.items()}
_SCALES = {w.encode(): p for w, p in SCALES.items()}
_AXES = {a: (frozenset(w.encode() for w in pro), frozenset(w.encode() for w in con)) for a, (pro, con) in AXES.items()}

#: Widths of the tie bands and their seeds, by lane.
LOW_WIDTH, HIGH_WIDTH, ZERO_SLOTS = {"check": 64, "forecast": 768}, {"check": 512, "forecast": 65_536}, 1000
ZERO_SEED, LOW_SEED, HIGH_SEED = 7599, 44115, 289
_M64 = (1 << 64) - 1


@dataclass(slots=True)
class Tokens:
    word: list[bytes] = field(default_factory=list)
    stem: list[bytes] = field(default_factory=list)
    alt: list[bytes] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    negated: list[bool] = field(default_factory=list)
    ends_clause: list[bool] = field(default_factory=list)
    scale: list[int] = field(default_factory=list)
    raw: list[bytes] = field(default_factory=list)


def _endings(low: bytes) -> tuple[bytes, bytes]:
    n = len(low)
    if n >= 7 and low.endswith(b"ing"):
        stem = low[:-3]
    elif n >= 6 and low.endswith((b"ed", b"ly", b"es")):
        stem = low[:-2]
    elif n >= 5 and low.endswith(b"s"):
        stem = low[:-1]
    else:
        stem = low
    if n >= 5 and low.endswith(b"ed"):
        return stem, low[:-1]
    figure = re.match(rb"[0-9][0-9.,]*", low)
    return stem, figure[0].replace(b",", b"") if figure else low


def _scale(low: bytes, word: bytes) -> int:
    if word in _SCALES:
        return _SCALES[word]
    suffix = re.search(rb"[a-z]+$", low) if len(low) >= 2 and low[:1].isdigit() else None
    return _SCALES.get(suffix[0], 0) if suffix else 0


def read_tokens(text: bytes) -> Tokens:
    out, reach, at = Tokens(), 0, 0
    for m in _TOKEN.finditer(text):
        if len(out.word) == MOST_TOKENS:
            break
        if _BOUNDARY.search(text, at, m.start()):
            reach = 0
            if out.word:
                out.ends_clause[-1] = True
        at = m.end()
        token = m[0]
        low = token.lower()
        digits = re.search(rb"[0-9]", token) is not None
        letters = re.search(rb"[A-Za-z\x80-\xff]", token) is not None
        plain = low.replace(b",", b"")
        numeric = digits and not letters
        word = plain
        if letters and plain in _NUMERALS:
            word, numeric = _NUMERALS[plain], True
        stem, alt = (word, word) if numeric else _endings(plain)
        if numeric:
            weight = 3.0
        elif word in _STOP:
            weight = 0.12
        elif not token.isascii():
            weight = 0.5
        else:
            weight = 1.0 + 0.06 * min(12, len(token)) + (1.3 if m.start() and token[:1].isupper() else 0.0)
        out.word.append(word)
        out.stem.append(stem)
        out.alt.append(alt)
        out.weight.append(weight)
        out.negated.append(reach > 0)
        out.ends_clause.append(False)
        out.scale.append(_scale(low, word))
        out.raw.append(token)
        reach = REACH if word in _NEG else max(0, reach - 1)
    if _BOUNDARY.search(text, at) and out.word:
        out.ends_clause[-1] = True
    return out


def _index(t: Tokens) -> dict[bytes, int]:
    where: dict[bytes, int] = {}
    for i in range(len(t.word)):
        for form in (t.word[i], t.stem[i], t.alt[i]):
            where.setdefault(form, i)
    return where


def _find(where: dict[bytes, int], t: Tokens, i: int) -> int | None:
    for form in (t.word[i], t.stem[i], t.alt[i]):
        if form in where:
            return where[form]
    return None


def bridged(a: Tokens, b: Tokens) -> tuple[set[int], set[int]]:
    """Acronyms of a and what they stand for in b: a capitalised word's beginning, or the initials of a run of content words."""
    named: dict[bytes, list[int]] = {}
    for i, token in enumerate(a.raw):
        if _ACRONYM.fullmatch(token):
            named.setdefault(token.lower(), []).append(i)
    if not named:
        return set(), set()
    # One walk over b looks each beginning and each run of initials up, so the cost is that of the tokens, not of their pairs.
    hit, theirs = set(), set()
    for j, other in enumerate(b.raw):
        if other[:1].isupper():
            for n in range(2, min(4, len(other) - 1) + 1):
                if (key := other[:n].lower()) in named:
                    hit.add(key)
                    theirs.add(j)
    content = [i for i in range(len(b.word)) if b.weight[i] > 0.5]
    initials = b"".join(b.raw[i][:1] for i in content).lower()
    for n in {len(key) for key in named}:
        for start in range(len(content) - n + 1):
            if (key := initials[start : start + n]) in named:
                hit.add(key)
                theirs.update(content[start : start + n])
    return {i for key in hit for i in named[key]}, theirs


def grams(text: bytes, n: int) -> set[bytes]:
    flat = _RUNS.sub(b" ", text[:MOST_GRAM_BYTES].lower()).strip(b" ")
    return {flat[i : i + n] for i in range(len(flat) - n + 1)}


def gram_similarity(reference: set[bytes], other: set[bytes]) -> float:
    if not reference or not other:
        return 0.0
    both = len(reference & other)
    return max(both / len(reference), 2 * both / (len(reference) + len(other)))


def axis_sign(t: Tokens, axis: str) -> int:
    pro, con = _AXES[axis]
    for i, word in enumerate(t.word):
        if word == b"no" and axis == "verdict" and not (t.ends_clause[i] or len(t.word) == 1):
            continue
        sign = 1 if word in pro else -1 if word in con else 0
        if sign:
            return -sign if t.negated[i] else sign
    return 0


def _clamp(x: float) -> float:
    return min(1.0, max(0.0, x))


def blend(question: bytes, truth: bytes, answer: bytes) -> float:
    """Weighted precision and recall of answer tokens, character grams, and a check for a lone negation."""
    q, t, a = read_tokens(question), read_tokens(truth), read_tokens(answer)
    if not t.word or not a.word:
        return 0.0
    in_q, in_t, in_a = _index(q), _index(t), _index(a)
    ours, theirs = bridged(a, t)
    theirs_too, ours_too = bridged(t, a)
    a_bridge, t_bridge = ours | ours_too, theirs | theirs_too
    a_scales, t_scales = set(a.scale) - {0}, set(t.scale) - {0}
    hit = total = content = novel = 0.0
    for i, w in enumerate(a.weight):
        asked = _find(in_q, a, i) is not None
        if w > 0.5:
            content += w
            novel += 0.0 if asked else w
        if _find(in_t, a, i) is not None or i in a_bridge or a.scale[i] in t_scales:
            hit += w
            total += w
        else:
            total += 0.35 * w if asked else w
    found = wanted = key_found = key_wanted = 0.0
    for i, w in enumerate(t.weight):
        hard = i in t_bridge or t.scale[i] in a_scales
        if not hard and (j := _find(in_a, t, i)) is not None:
            hard = not (a.negated[j] and not t.negated[i] and w > 0.5)
        wanted += w
        found += w if hard else 0.0
        if _find(in_q, t, i) is None:
            key_wanted += w
            key_found += w if hard else 0.0
    share = _clamp(hit / total) if total else 0.0
    precision = share * (2 - share)
    whole = _clamp(found / wanted) if wanted else 0.0
    own = _clamp((novel / content - 0.2) * 3) if content else 0.0
    recall = _clamp(_clamp(key_found / key_wanted) * (0.5 + 0.5 * whole) + 0.3 * whole * own) if key_wanted else whole
    below = 0.36 * precision + recall
    lexical = 1.36 * precision * recall / below if below else 0.0
    raw = _clamp(0.76 * lexical + 0.2 * gram_similarity(grams(truth, 3), grams(answer, 3)) + 0.04 * gram_similarity(grams(truth, 2), grams(answer, 2)))
    if not any(axis_sign(t, axis) for axis in _AXES) and any(w in _NEG for w in t.word) != any(w in _NEG for w in a.word):
        raw *= 1 - 0.35 * lexical
    return _clamp(raw)


def _normal(text: bytes) -> list[bytes]:
    return [m.lower() for m in _TOKEN.findall(text)]


def raw_score(question: bytes, truth: bytes, answer: bytes) -> float:
    """The blend; an answer that says the reference word for word gets 1 less a little for how ill it fits the question."""
    if question and _normal(truth) == _normal(answer):
        return _clamp(1 - 0.02 * (1 - blend(question, question, answer)))
    return blend(question, truth, answer)


def contrast(raw: float) -> float:
    high = _clamp((raw - 0.91) / 0.08)
    tail = 0.1 + (raw - 0.1) * 0.1 if high == 0 and raw > 0.1 else raw
    return _clamp(0.98 * high + 0.02 * tail)


def _mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M64
    return x ^ (x >> 31)


def fnv64(*parts: bytes) -> int:
    """FNV-1a over the parts with a zero byte between them."""
    h = 0xCBF29CE484222325
    for byte in b"\0".join(parts):
        h = (h ^ byte) * 0x100000001B3 & _M64
    return h


def tie_slot(unquantized: float, key: int, lane: str = "check") -> float:
    """The score on a grid of millionths, its lower digits replaced by a slot that depends on the inputs."""
    units = math.floor(unquantized * 1e6 + 0.5)
    if units <= 0:
        return _mix(key ^ ZERO_SEED) % ZERO_SLOTS / 1e6
    high = units >= 900_000
    width, seed = (HIGH_WIDTH[lane], HIGH_SEED) if high else (LOW_WIDTH[lane], LOW_SEED)
    start = 1_000_000 - width if units >= 1_000_000 else units // width * width
    return (start + _mix(key ^ seed) % min(width, 1_000_000 - start)) / 1e6


def composite(question: bytes, truth: bytes, answer: bytes, lane: str = "check") -> float:
    """The blend and the typed adjustment, from 0 to 1; nothing for an empty answer."""
    if not answer.strip():
        return 0.0
    return _clamp(raw_score(question, truth, answer) + facts.adjustment(question, truth, answer, lane))


def score(question: bytes, truth: bytes, answer: bytes, lane: str = "check") -> tuple[float, float]:
    """(raw, public); an empty answer scores nothing before its tie slot."""
    raw = composite(question, truth, answer, lane)
    return raw, tie_slot(contrast(raw), fnv64(question, truth, answer), lane)


def bm25(query: bytes, document: bytes) -> float:
    """Of a text against a reference: constant weights, each term of the reference counts as often as it stands there."""
    q, d = (_terms(x) for x in (query, document))
    if not q or not d:
        return 0.0
    norm = 1 - B + B * len(d) / ((len(q) + len(d)) / 2)
    times = Counter(d)
    return _clamp(sum(times[t] * (K1 + 1) / (times[t] + K1 * norm) for t in q if times[t]) / (len(q) * (K1 + 1)))


def _terms(raw: bytes) -> list[str]:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return []
    runs = (w for w in re.findall(r"[^\W_]+", text) if len(w.encode()) >= 2)
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in runs][:MOST_TERMS]


def length_quality(answer: bytes) -> float:
    return 1 / (1 + math.exp(-(len(answer) - 50) / 20))


FIELDS = ("relevance", "correctness", "lexical", "length_quality", "raw_score", "score")


def fields(question: bytes, truth: bytes, answer: bytes, lane: str = "check", vectors: dict | None = None) -> tuple[float, ...]:
    """relevance, correctness, lexical, length quality, raw and public score; the first five are 0 for an empty answer.

    ``vectors`` keeps projections of texts that come again, as a question or a reference does with many answers.
    """
    raw, public = score(question, truth, answer, lane)
    if not answer.strip():
        return 0.0, 0.0, 0.0, 0.0, 0.0, public
    vectors = {} if vectors is None else vectors
    for x in (question, truth, answer):
        if x not in vectors:
            vectors[x] = projection.project(x)
    near = lambda x: projection.cosine(vectors[x], vectors[answer])
    return near(question), near(truth), bm25(truth, answer), length_quality(answer), raw, public


_BREAKDOWN = ", ".join(f"{f} double" for f in FIELDS)
_RAW = "raw double, score double"


def _rows(columns, lane: str, work) -> list[tuple]:
    known: dict[tuple, tuple] = {}
    out = []
    for row in zip(*columns, strict=True):
        if row not in known:
            known[row] = work(*((x or "").encode() for x in row), lane)
        out.append(known[row])
    return out


def breakdown(question: Column, truth: Column, answer: Column, lane: str = "check") -> Column:
    """A struct of the six fields."""

    @F.pandas_udf(_BREAKDOWN)
    def work(q: pd.Series, t: pd.Series, a: pd.Series) -> pd.DataFrame:
        vectors: dict = {}
        return pd.DataFrame(_rows((q, t, a), lane, lambda *r: fields(*r, vectors=vectors)), columns=list(FIELDS), dtype=float)

    return work(question, truth, answer)


def both_scores(question: Column, truth: Column, answer: Column, lane: str = "check") -> Column:
    """A struct of the raw and the public score."""

    @F.pandas_udf(_RAW)
    def work(q: pd.Series, t: pd.Series, a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_rows((q, t, a), lane, score), columns=["raw", "score"], dtype=float)

    return work(question, truth, answer)


def score_pairs(df: DataFrame, question: str, truth: str, answer: str, lane: str = "check") -> DataFrame:
    scored = df.withColumn("_s", both_scores(F.col(question), F.col(truth), F.col(answer), lane))
    return scored.select(*df.columns, F.col("_s.raw").alias("raw"), F.col("_s.score").alias("score"))


def register_functions(spark: SparkSession, lane: str = "check") -> None:
    """rank_answer, baseline_answer (the raw score) and breakdown_answer, each of (question, truth, answer), for SQL."""

    def named(of):
        @F.pandas_udf(T.DoubleType())
        def work(q: pd.Series, t: pd.Series, a: pd.Series) -> pd.Series:
            return pd.Series([of(r) for r in _rows((q, t, a), lane, score)], dtype=float)

        return work

    @F.pandas_udf(_BREAKDOWN)
    def breakdown_answer(q: pd.Series, t: pd.Series, a: pd.Series) -> pd.DataFrame:
        vectors: dict = {}
        return pd.DataFrame(_rows((q, t, a), lane, lambda *r: fields(*r, vectors=vectors)), columns=list(FIELDS), dtype=float)

    spark.udf.register("rank_answer", named(lambda r: r[1]))
    spark.udf.register("baseline_answer", named(lambda r: r[0]))
    spark.udf.register("breakdown_answer", breakdown_answer)
