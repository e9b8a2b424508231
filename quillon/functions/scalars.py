"""Scalar column functions: codes, units, rounding, dates and request fields."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.tables import COMPASS, CONDITIONS

KNOTS_PER_MS = 1.94384449
HIGH_WIND_MS = 25 * 0.514444


def _map(pairs) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs)))


def finite(x: Column) -> Column:
    """The value, or null where it is missing, not a number or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards positive infinity."""
    return F.floor(x + 0.5)


def to_fixed1(x: Column) -> Column:
    """One decimal as text, by the exact binary value; exact ties go away from zero."""
    tie = F.pmod(F.abs(x) * 4, F.lit(2.0)) == 1
    away = F.signum(x) * (F.floor(F.abs(x) * 10 + 0.5) / 10)
    return F.regexp_replace(F.format_number(F.when(tie, away).otherwise(x), 1), ",", "")


def fixed(x: Column, places: int) -> Column:
    """So many decimals as text, by the exact binary value, as C prints it; format_string rounds the shortest decimal instead."""
    return F.replace(F.format_number(x, places), F.lit(","), F.lit(""))


def compass_point(degrees: Column) -> Column:
    """The nearest of the sixteen points; any angle, negative ones too."""
    at = F.pmod(F.floor((degrees + 11.25) / 22.5).cast("int"), F.lit(16))
    return F.element_at(F.array(*(F.lit(p) for p in COMPASS)), at + 1)


def wind_ms(speed: Column, unit: Column) -> Column:
    """Metres per second from km/h, mph or m/s."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    return F.when(u.contains("km"), speed / 3.6).when(u.contains("mph"), speed * 0.44704).otherwise(speed)


def fahrenheit(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32


def condition_phrase(code: Column) -> Column:
    known = F.try_element_at(_map((c, p) for c, p, _ in CONDITIONS), code)
    return F.coalesce(known, F.format_string("unknown conditions (code %d)", code))


def condition_slug(code: Column) -> Column:
    known = F.try_element_at(_map((c, s) for c, _, s in CONDITIONS), code)
    return F.coalesce(known, F.format_string("unknown_%d", code))


def condition_code(slug: Column) -> Column:
    return F.try_element_at(_map((s, c) for c, _, s in CONDITIONS), slug)


def is_precipitation(code: Column) -> Column:
    return code.between(51, 67) | code.between(71, 86) | code.between(95, 99)


def coarse_condition(code: Column) -> Column:
    return (
        F.when(code.between(95, 99), "Thunderstorm")
        .when(code.between(51, 57), "Drizzle")
        .when(code.between(61, 67) | code.between(80, 82), "Rain")
        .when(code.between(71, 77), "Snow")
        .when(code.between(85, 86), "Snow showers")
        .otherwise(condition_phrase(code))
    )


def dominant_condition(code: Column) -> Column:
    """An aggregate: the condition that stands for a set of codes, the most severe first."""
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    return (
        F.when(some(is_precipitation(code)) & some(code >= 95), "scattered showers or thunderstorms")
        .when(some(is_precipitation(code)), "rain or showers")
        .when(some(code.isin(45, 48)), "fog")
        .when(some(code == 3), "overcast")
        .when(some(code == 2), "partly cloudy")
        .when(some(code == 1), "mainly clear")
        .when(some(code == 0), "clear")
    )


def risk_score(gust_kmh: Column, wind_kmh: Column, probability: Column, precipitation: Column, thunder: Column) -> Column:
    """From peak values of a window: wind against 160 km/h, rain, and a floor for thunder; two decimals."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    wind = F.greatest(zero(gust_kmh), zero(wind_kmh)) / 160
    rain = F.least(F.lit(1.0), zero(probability) / 100 * 0.4 + zero(precipitation) / 25)
    return F.round(F.least(F.lit(1.0), F.greatest(wind, rain, F.when(thunder, 0.25).otherwise(0.0))), 2)


def risk_label(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "elevated").when(score >= 0.25, "moderate").when(score >= 0.1, "low").otherwise("none")


def clean(x: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def day_span(start: Column, end: Column) -> Column:
    """Days from start to end, both counted; null unless positive."""
    span = F.datediff(end, start) + 1
    return F.when(span > 0, span)


def place_label(*parts: Column) -> Column:
    return F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts))


def joined_terms(terms: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(terms)
    many = F.concat(F.array_join(F.slice(terms, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(terms, -1))
    return F.when(n == 0, "").when(n == 1, terms[0]).when(n == 2, F.array_join(terms, " and ")).otherwise(many)


def field_terms(fields: Column) -> Column:
    """The phrases for the fields that a request names."""
    text = F.regexp_replace(F.lower(F.coalesce(fields, F.lit(""))), "[_-]+", " ")
    terms = F.array(
        F.when(text.contains("temperature"), "temperature in Celsius"),
        F.when(text.contains("precipitation probability"), "precipitation probability").when(text.contains("precipitation"), "precipitation"),
        F.when(text.contains("wind speed"), "wind speed"),
    )
    return F.array_compact(terms)
