"""Cleaning, scraping, mutation and flattening of captured records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT_SWAPS = [("km/h", "m/s"), ("mm", "cm"), ("C", "F")]


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def strip_html(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; the common entities are read; white space is collapsed."""
    bare = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return one_line(bare)


def shift_first_number(text: Column, by: int = 10) -> Column:
    """The first whole number is moved up, or down if it is as large as the step."""
    number = F.regexp_extract(text, "([0-9]{1,9})", 1)
    value = F.try_to_number(number, F.lit("999999999")).cast("bigint")
    moved = F.when(value >= by, value - by).otherwise(value + by).cast("string")
    return F.when(number == "", text).otherwise(F.concat(F.regexp_extract(text, "(?s)^([^0-9]*)[0-9]{1,9}", 1), moved, F.regexp_extract(text, "(?s)^[^0-9]*[0-9]{1,9}(.*)$", 1)))


def swap_word(text: Column, word: str, other: str) -> Column:
    """The first whole occurrence is replaced."""
    guard = r"[A-Za-z0-9_]"
    pattern = rf"(?s)^(.*?)(?<!{guard}){word}(?!{guard})(.*)$"
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, f"$1{other}$2")).otherwise(text)


def mutate(text: Column, index: Column, city: str = "Atlantis") -> Column:
    """The first of five changes, in an order that turns with the index, that does change the text."""
    made = F.array(shift_first_number(text), swap_word(text, "the", "a"), swap_word(text, "is", "is not"), F.concat(text, F.lit(f" in {city}")), F.concat(F.lit("Not so: "), text))
    turn = F.pmod(index, F.lit(5)).cast("int")
    turned = F.concat(F.slice(made, turn + 1, F.lit(5)), F.slice(made, F.lit(1), turn))
    return F.filter(turned, lambda x: x != text)[0]


def flatten_registry(df: DataFrame, registry: str) -> DataFrame:
    """One row per entry of a map of intents; intents without entries keep a row."""
    intents = df.select(F.explode_outer(registry).alias("intent", "body"))
    return intents.select("intent", F.col("body.champion.registration_id").alias("champion"), F.explode_outer("body.entries").alias("entry")).select("intent", "champion", "entry.*")


REGISTRY = (
    "MAP<STRING, STRUCT<champion STRUCT<registration_id INT, eval_score DOUBLE>, entries ARRAY<STRUCT<registration_id INT, rank INT, activation_status STRING,"
    " eval_score DOUBLE, rejection_reason STRING>>>>"
)


def with_prefix_if_any(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Only rows whose column has the prefix, if any row has it; else all rows."""
    marked = F.col(column).startswith(prefix)
    some = df.agg(F.coalesce(F.bool_or(marked), F.lit(False)).alias("_some"))
    return df.join(F.broadcast(some), F.coalesce(marked, F.lit(False)) | ~F.col("_some")).drop("_some")


def without_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Without the helper columns, known by their suffix."""
    return df.drop(*(c for c in df.columns if c.endswith(suffix)))


def ledger_row(df: DataFrame, name: str, lat: str, lon: str, factor: int = 10_000) -> DataFrame:
    """The place and its coordinates as whole numbers, scaled and cut towards zero."""
    return df.select(F.col(name).alias("location"), *((F.col(c) * factor).cast("int").alias(n) for c, n in ((lat, "latitude_e4"), (lon, "longitude_e4"))))


SCRAPE_WORDS = ("failed", "rejected", "agreement", "margin", "eval")
_SHARE = r"(0?\.\d+|1(?:\.0+)?)"


def scraped_records(text: Column) -> Column:
    """Records of a page's text, one per line that speaks of an evaluation: line (from 1), margin, agreement, numbers and the line."""
    lines = F.filter(F.transform(F.split(text, r"[\n\r]+"), F.trim), lambda x: x != "")

    def number(line: Column, pattern: str) -> Column:
        return F.regexp_extract(line, pattern, 1).try_cast("double")

    def record(line: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).alias("line"),
            number(line, rf"(?i)(?:margin|eval(?:uation)?|separation)\s*[:=]?\s*{_SHARE}").alias("margin"),
            number(line, r"(?i)agreement\s*[:=]?\s*(-?0?\.\d+|-?1(?:\.0+)?)").alias("agreement"),
            F.transform(F.regexp_extract_all(line, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double")).alias("numbers"),
            line.alias("text"),
        )

    said = lambda r: F.lower(r["text"]).rlike("|".join(SCRAPE_WORDS))
    return F.filter(F.transform(lines, record), said)

