"""Tokens, weights, stems, n-grams and similarity of texts, as column functions over arrays."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.tables import AXES, NEGATORS, NUMERALS, SCALES, STOPWORDS

_W = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
#: A word, or a figure whose commas and points stand between digits.
TOKEN = rf"(?:{_W}*[0-9][.,])*[0-9]{_W}*|{_W}+"
#: Runs of letters and digits of any script.
TERM = r"[\p{L}\p{N}]+"
#: A figure and the letters that stand on it or follow it after spaces.
FIGURE = r"[0-9][0-9,]*(?:\.[0-9]+)?(?:[ ]*[A-Za-z]+)?"
MOST_TOKENS, MOST_TERMS = 2048, 256
K1, B = 1.5, 0.75


def tokens(text: Column, most: int = MOST_TOKENS) -> Column:
    return F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), 1, most)


def ascii_lower(x: Column) -> Column:
    plain = F.octet_length(x) == F.char_length(x)
    return F.when(plain, F.lower(x)).otherwise(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _words(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def normal_form(token: Column) -> Column:
    """Lower case, thousands commas dropped, number words as digits."""
    return _as_digits(_bare(token))


def _bare(token: Column) -> Column:
    return F.replace(ascii_lower(token), F.lit(","), F.lit(""))


def _as_digits(low: Column) -> Column:
    return F.when(low.isin(*NUMERALS), _lookup(NUMERALS, low)).otherwise(low)


def _is_figure(token: Column) -> Column:
    """Nothing but digits and what stands between them."""
    return F.translate(token, "0123456789.,", "") == ""


def is_numeric(token: Column) -> Column:
    return _is_figure(token) | ascii_lower(token).isin(*NUMERALS)


def stem(token: Column) -> Column:
    """The lower-cased token without one common ending; lengths are bytes."""
    low, n = _bare(token), F.octet_length(token)
    cut = lambda k: F.substring(low, F.lit(1), F.length(low) - k)
    return (
        F.when(is_numeric(token), normal_form(token))
        .when((n >= 7) & low.endswith("ing"), cut(3))
        .when((n >= 6) & (low.endswith("ed") | low.endswith("ly") | low.endswith("es")), cut(2))
        .when((n >= 5) & low.endswith("s"), cut(1))
        .otherwise(low)
    )


def alternate(token: Column) -> Column:
    """A second key: -ed to -e, or the figure that a unit is glued to."""
    low, n = _bare(token), F.octet_length(token)
    return (
        F.when(is_numeric(token), normal_form(token))
        .when((n >= 5) & low.endswith("ed"), F.substring(low, F.lit(1), F.length(low) - 1))
        .when(token.rlike("^[0-9]"), F.regexp_replace(F.regexp_extract(token, "^[0-9.,]+", 0), ",", ""))
        .otherwise(low)
    )


def weight(token: Column, first: Column) -> Column:
    """Figures 3, stopwords 0.12, other scripts 0.5, else by length, more for a capital that does not open the text."""
    return weight_of(token, _bare(token), first)


def weight_of(token: Column, low: Column, first: Column) -> Column:
    """weight(), where the lower-cased token without commas is at hand."""
    proper = F.when(~first & F.left(token, F.lit(1)).between("A", "Z"), 1.3).otherwise(0.0)
    return (
        F.when(_is_figure(token) | low.isin(*NUMERALS), 3.0)
        .when(low.isin(*STOPWORDS), 0.12)
        .when(F.octet_length(token) != F.char_length(token), 0.5)
        .otherwise(1.0 + 0.06 * F.least(F.lit(12), F.octet_length(token)) + proper)
    )


def weights(text: Column, most: int | None = MOST_TOKENS) -> Column:
    """The weights of a text's tokens in order; ``most`` is the score's cap, None reads all."""
    opens = F.coalesce(text.rlike(r"^[A-Za-z0-9]"), F.lit(False))
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)) if most is None else tokens(text, most)
    both = F.transform(found, lambda t: F.struct(t.alias("t"), _bare(t).alias("low")))
    return F.transform(both, lambda x, i: weight_of(x["t"], x["low"], (i == 0) & opens))


def scale(token: Column) -> Column:
    """The power of ten that a scale word, or a suffix on a figure, stands for."""
    low = ascii_lower(token)
    suffix = F.when(token.rlike("^[0-9]"), _lookup(SCALES, F.regexp_extract(low, "([a-z]+)$", 1)))
    return F.coalesce(_lookup(SCALES, low), suffix, F.lit(0))


def is_negator(token: Column) -> Column:
    return normal_form(token).isin(*NEGATORS)


def axis_words(axis: str) -> tuple[list[str], list[str]]:
    return AXES[axis]


def bm25_terms(text: Column) -> Column:
    """Lower-cased runs of at least two bytes, the first 256."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), ascii_lower)
    return F.slice(F.filter(found, lambda t: F.octet_length(t) >= 2), 1, MOST_TERMS)


def bm25(query: Column, document: Column) -> Column:
    """Each query term's saturated count in the document, against the most it could be; lengths against their mean."""
    nq, nd = F.size(query).cast("double"), F.size(document).cast("double")
    norm = K1 * (1 - B + B * nd / ((nq + nd) / 2))
    total = F.aggregate(
        query,
        F.lit(0.0),
        lambda acc, t: acc + (lambda tf: tf * (K1 + 1) / (tf + norm))(F.size(F.filter(document, lambda d: d == t)).cast("double")),
    )
    return F.when((nq == 0) | (nd == 0), 0.0).otherwise(F.least(F.lit(1.0), total / (nq * (K1 + 1))))


def char_grams(text: Column, n: int) -> Column:
    """Distinct n-grams of the lower-cased text with runs of other signs as one space."""
    flat = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[^A-Za-z0-9\x{80}-\x{10FFFF}]+", " ")
    # The characters are bound once by a one-element array, so that they are not worked out again for each gram.
    made = F.transform(
        F.array(F.split(flat, "")),
        lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*(c[i + k] for k in range(n)))),
    )[0]
    return F.when(F.length(flat) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(made))


def dice(a: Column, b: Column) -> Column:
    both, total = F.size(F.array_intersect(a, b)).cast("double"), (F.size(a) + F.size(b)).cast("double")
    return F.when(total == 0, 0.0).otherwise(F.try_divide(2 * both, total))


def containment(a: Column, b: Column) -> Column:
    """The share of a's items that b has."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double")))


def normal_text(text: Column) -> Column:
    """Word characters only, lower-cased: what two spellings of one answer share."""
    return F.array_join(F.transform(tokens(text, 1 << 30), ascii_lower), " ")


def fnv32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    return F.aggregate(
        pairs,
        F.lit(2166136261).cast("bigint"),
        lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("bigint")) * 16777619).bitwiseAND(4294967295),
    )


def whole_word_count(text: Column, words: list[str]) -> Column:
    """How often any of the words stands whole; underscores and letters of other scripts are word characters."""
    guard = r"[A-Za-z0-9_\x{80}-\x{10FFFF}]"
    return F.regexp_count(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<!{guard})(?:{'|'.join(words)})(?!{guard})"))


def figure_values(text: Column) -> Column:
    """Figures of a text, commas dropped, times the scale word or suffix behind them: an array of value and scale (a power of ten)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIGURE), F.lit(0))

    def one(m: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(m, r"^[0-9][0-9,]*(?:\.[0-9]+)?", 0), ",", "").cast("double")
        power = F.coalesce(_lookup(SCALES, ascii_lower(F.regexp_extract(m, "([A-Za-z]*)$", 1))), F.lit(0))
        return F.struct((number * F.pow(F.lit(10.0), power)).alias("value"), power.alias("scale"))

    return F.transform(found, one)


def close(a: Column, b: Column, most: float = 0.005) -> Column:
    """Whether two figures differ by at most half a percent of the larger one."""
    larger = F.greatest(F.abs(a), F.abs(b))
    return F.when(larger == 0, True).otherwise(F.abs(a - b) / larger <= most)
