"""Secret scans in DataFrame functions only: fixed patterns, and a randomness test battery for other strings.

Fixed patterns ("base" spans) are found leftmost and without overlap, each kind on its own.

The battery looks at every maximal run of 20 or more of ``A-Z a-z 0-9 + / _ -`` (with up to two ``=``). The narrowest
alphabet that holds all of its symbols is taken as its encoding. Against "the symbols are drawn evenly and
independently" three tests are made: chi-squared uniformity over the alphabet (Wilson-Hilferty), runs above and below
the middle of the alphabet (Wald-Wolfowitz) and lag-one serial correlation. A string is taken as random when the
smallest of the three p-values, times three, is at least ``keep_level``.

What is reported must also be a discovery against "it is written text". What that says depends on the encoding. In
decimal, written digits are padding, counters and repeats, whose neighbours mostly differ by one at most. In letters of
one case, letters are as frequent as in written languages. In all others, letters are so too, and neighbours rarely
change between lower case, upper case, digits and signs; the two are added up as log-likelihoods. Each sum has an
upper-tail normal p-value, which by itself is stronger for longer strings. All candidates of a document are one family, on which the Benjamini-Hochberg
step-up runs at ``false_discovery_rate`` with weights in proportion to length (mean 1). No state outside the row is
needed, so there is no shuffle, and equal texts always get equal spans.

Spans are code points from 0, the end exclusive. Defined cases: a null text counts as empty and has no spans; repeated
rows are scanned one by one; null ids pass through; an empty table gives an empty result; columns the caller does not
name are ignored. Texts of any length are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.arrays import prefix_sums
from quillon.llm.batches import kept_names
from quillon.session import table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

FALSE_DISCOVERY_RATE = 0.01
KEEP_LEVEL = 0.01
#: Share of neighbours in written text that change between the four classes of characters.
TEXT_CHANGE = 0.15
#: What a change counts for beside a letter's surprise: the log odds of one half against TEXT_CHANGE.
CHANGE_WEIGHT = math.log((1 - TEXT_CHANGE) / TEXT_CHANGE)
#: Share of neighbours in written digits that differ by more than one.
TEXT_STEP = 1 / 3
#: Occurrences of a to z in a thousand letters, roughly the mean of English, German, French and Spanish.
LETTERS = (84, 16, 32, 45, 142, 14, 19, 31, 71, 4, 5, 45, 28, 76, 61, 19, 6, 66, 74, 68, 40, 11, 11, 2, 8, 5)
#: What lies outside this many standard deviations has the same p-value.
_Z_MAX = 30.0

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, pattern of the whole string and alphabet, narrowest first; - and _ stand for + and / of the last.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", _DIGITS),
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", r"^[a-z]+$", _LOWER),
    ("upper", r"^[A-Z]+$", _UPPER),
    ("base32", r"^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", r"^[a-z0-9]+$", _DIGITS + _LOWER),
    ("base36_upper", r"^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("base62", r"^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
)

_SHARES = [x / sum(LETTERS) for x in LETTERS]
_ENTROPY = -sum(p * math.log(p) for p in _SHARES)
_ENTROPY_VARIANCE = sum(p * (math.log(p) + _ENTROPY) ** 2 for p in _SHARES)
#: By position in the alphabet; 0 is no letter.
_SURPLUS = [0.0, *(-math.log(p) - _ENTROPY for p in _SHARES)]

_SPANS = "array<struct<start:bigint,end:bigint,match:string,value:string>>"


def _found(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Spans of all matches: what lies between the matches, and the matches, add up to the positions."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if not value_group else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: p + F.length(m))
    spans = F.transform(
        F.arrays_zip(prefix_sums(lengths).alias("end"), matches.alias("match"), values.alias("value")),
        lambda x: F.struct(
            (x["end"] - F.length(x["match"])).alias("start"), x["end"], x["match"].alias("match"), x["value"].alias("value")
        ),
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def upper_tail(z: Column) -> Column:
    """P(normal > z), by the usual five-term approximation of the error function (absolute error below 1e-7)."""
    z = F.greatest(F.lit(-_Z_MAX), F.least(F.lit(_Z_MAX), z))
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * series * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def _measure(run: Column) -> Column:
    """What the tests need of one candidate: symbol indexes, alphabet size, symbol counts, changes of class."""
    body = F.translate(F.regexp_replace(run, "=+$", ""), "-_", "+/")
    alphabet = F.lit(ENCODINGS[-1][2])
    for _, pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(body.rlike(pattern), letters).otherwise(alphabet)
    classes = F.translate(body, _LOWER + _UPPER + _DIGITS + "+/", "a" * 26 + "A" * 26 + "0" * 10 + "++")
    return F.struct(
        body.alias("body"),
        alphabet.alias("alphabet"),
        F.regexp_count(classes, F.lit(r"a+|A+|0+|\++")).alias("runs_of_class"),
    )


def _indexed(x: Column) -> Column:
    body = x["body"]
    return F.struct(
        F.length(body).cast("double").alias("n"),
        F.length(x["alphabet"]).cast("double").alias("k"),
        (x["runs_of_class"] - 1).cast("double").alias("changes"),
        F.length(F.translate(body, _DIGITS + "+/", "")).cast("double").alias("letters"),
        F.aggregate(
            F.split(F.lower(body), ""),
            F.lit(0.0),
            lambda acc, c: acc + F.get(F.array(*map(F.lit, _SURPLUS)), F.position(c, F.lit(_LOWER))),
        ).alias("surplus"),
        F.transform(F.split(body, ""), lambda c: F.position(c, x["alphabet"]).cast("double")).alias("at"),
        F.aggregate(
            F.array_distinct(F.split(body, "")),
            F.lit(0.0),
            lambda acc, c: acc
            + F.pow((F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"), F.lit(2.0)),
        ).alias("squares"),
    )


def _sums(x: Column) -> Column:
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    middle = x["k"] / 2 + 0.5
    signs = F.array_join(F.transform(x["at"], lambda v: F.when(v > middle, "h").otherwise("l")), "")
    after = F.slice(x["at"], F.lit(2), F.size(x["at"]))
    mean = add(x["at"]) / x["n"]
    return F.struct(
        *(x[c].alias(c) for c in ("n", "k", "changes", "letters", "surplus", "squares")),
        F.regexp_count(signs, F.lit("h")).cast("double").alias("high"),
        F.regexp_count(signs, F.lit("h+|l+")).cast("double").alias("runs"),
        add(F.zip_with(F.slice(x["at"], F.lit(1), F.size(after)), after, lambda a, b: F.when(F.abs(a - b) > 1, 1.0).otherwise(0.0))).alias("far"),
        add(F.transform(x["at"], lambda v: (v - mean) * (v - mean))).alias("spread"),
        add(
            F.zip_with(F.slice(x["at"], F.lit(1), F.size(after)), after, lambda a, b: (a - mean) * (b - mean))
        ).alias("lagged"),
    )


def _p_values(x: Column) -> Column:
    n, k = x["n"], x["k"]
    chi = k / n * x["squares"] - n
    free = k - 1
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    both = 2 * x["high"] * (n - x["high"])
    variance = both * (both - n) / (n * n * (n - 1))
    p_runs = F.when(variance > 0, 2 * upper_tail(F.try_divide(F.abs(x["runs"] - (both / n + 1)), F.sqrt(variance)))).otherwise(0.0)
    p_lag = F.when(
        x["spread"] > 0, 2 * upper_tail(F.abs(F.try_divide(x["lagged"], x["spread"]) + 1 / n) * F.sqrt(n))
    ).otherwise(0.0)
    changes = x["changes"] - (n - 1) * TEXT_CHANGE - 0.5
    both_vary = x["letters"] * _ENTROPY_VARIANCE + CHANGE_WEIGHT**2 * (n - 1) * TEXT_CHANGE * (1 - TEXT_CHANGE)
    z_text = (
        F.when(k == len(_DIGITS), (x["far"] - (n - 1) * TEXT_STEP - 0.5) / F.sqrt((n - 1) * TEXT_STEP * (1 - TEXT_STEP)))
        .when(k == len(_LOWER), x["surplus"] / F.sqrt(n * _ENTROPY_VARIANCE))
        .otherwise((x["surplus"] + CHANGE_WEIGHT * changes) / F.sqrt(both_vary))
    )
    p_text = upper_tail(z_text)
    return F.struct(
        F.least(F.lit(1.0), 3 * F.least(upper_tail(z_chi), p_runs, p_lag)).alias("p_random"), p_text.alias("p_text"), n.alias("n")
    )


def scan(
    df: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    false_discovery_rate: float = FALSE_DISCOVERY_RATE,
    keep_level: float = KEEP_LEVEL,
) -> DataFrame:
    """The ``keep`` columns and ``base`` and ``found``: arrays of (start, kind_no, end) by start, then kind.

    ``base`` has the fixed patterns' spans, ``found`` these and the battery's; ``kind_no`` counts KINDS from 0. Kept columns of
    these two names come out with ``input_`` before them.
    """
    body = F.col("_text")
    whole = df.select(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).alias("_kept"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    raw = whole.select(
        "_kept",
        F.filter(_found(body, ASSIGN, 2), lambda x: F.length(x["value"]) >= 12).alias("_assign"),
        _found(body, ACCESS).alias("_access"),
        _found(body, HEX).alias("_hex"),
        _found(body, CANDIDATE).alias("_runs"),
    )
    tested = raw.withColumn(
        "_tests",
        F.transform(
            F.transform(F.transform(F.transform("_runs", lambda x: _measure(x["match"])), _indexed), _sums), _p_values
        ),
    )
    mean = F.try_divide(F.aggregate("_tests", F.lit(0.0), lambda a, t: a + t["n"]), F.size("_tests"))
    weighed = tested.withColumn(
        "_ranked",
        F.array_sort(F.transform("_tests", lambda t: F.struct((t["p_text"] * mean / t["n"]).alias("q"), t["p_text"].alias("p")))),
    ).withColumn("_mean", mean)
    limit = F.array_max(
        F.filter(
            F.transform(
                "_ranked",
                lambda t, i: F.when(t["q"] <= (i + 1) * F.lit(false_discovery_rate) / F.size("_ranked"), t["q"]),
            ),
            lambda q: q.isNotNull(),
        )
    )
    limited = weighed.withColumn("_limit", limit)
    kind = lambda no, spans: F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("kind_no"), x["end"].alias("end"))
    )
    chosen = F.filter(
        F.arrays_zip(F.col("_runs").alias("run"), F.col("_tests").alias("test")),
        lambda x: (x["test"]["p_random"] >= keep_level)
        & (x["test"]["p_text"] * F.col("_mean") / x["test"]["n"] <= F.col("_limit")),
    )
    based = limited.withColumn(
        "base", F.array_sort(F.concat(kind(0, F.col("_assign")), kind(1, F.col("_access")), kind(2, F.col("_hex"))))
    ).withColumn("_random", kind(3, F.transform(chosen, lambda x: x["run"])))
    names = kept_names(keep, ("base", "found"))
    return based.select(
        *(F.col(f"_kept.k{i}").alias(n) for i, n in enumerate(names)), "base", F.array_sort(F.concat("base", "_random")).alias("found")
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.element_at(names, x["kind_no"] + 1), x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.array().cast("array<string>").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(
            spans,
            start,
            lambda acc, x: F.struct(
                F.greatest(acc["upto"], x["end"]).alias("upto"),
                F.when(
                    (x["start"] >= acc["upto"]),
                    F.concat(
                        acc["out"],
                        F.array(
                            F.concat(
                                text.substr((acc["upto"] + 1).cast("int"), (x["start"] - acc["upto"]).cast("int")), F.lit(mark)
                            )
                        ),
                    ),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
            lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr((acc["upto"] + 1).cast("int"), F.length(text))),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda no: F.size(F.filter("base", lambda x: x["kind_no"] == no)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )
