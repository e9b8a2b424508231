"""Answers for places: the steps of functions/reports.py one after another, each a column that the next one reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import reports as R
from quillon.functions import requests as Q

_OWN = "_report_"


def staged(df: DataFrame, **steps) -> tuple[DataFrame, dict[str, Column]]:
    """df with a column per step; a step is a column, or a function of the columns before it."""
    made: dict[str, Column] = {}
    for name, step in steps.items():
        df = df.withColumn(_OWN + name, step(made) if callable(step) else step)
        made[name] = F.col(_OWN + name)
    return df, made


def _answered(df: DataFrame, answer: str, column: Column, **more: Column) -> DataFrame:
    done = df.withColumn(answer, column)
    for name, c in more.items():
        done = done.withColumn(name, c)
    return done.drop(*(c for c in done.columns if c.startswith(_OWN)))


def current_answer(df: DataFrame, place: Column, short: Column, current: Column, unit: Column, hours: Column, stale: Column | None = None) -> DataFrame:
    """df with ``answer`` and ``current_values``; the 24 hours ahead run from the observation's time."""
    df, c = staged(df, current=current, ahead=lambda c: R.horizon(hours, c["current"]["time"]))
    return _answered(df, "answer", R.current_text(place, short, c["current"], unit, c["ahead"], F.lit(False) if stale is None else stale), current_values=R.current_values(c["current"], unit))


def storm_answer(df: DataFrame, short: Column, hours: Column, unit: Column, asked: Column, request: Column, stale: Column | None = None) -> DataFrame:
    """df with ``answer`` and ``storm``, over the first ``asked`` hours."""
    df, c = staged(df, rows=R.storm_rows(hours, unit, asked), storm=lambda c: R.storm_values(c["rows"]))
    return _answered(df, "answer", R.storm_text(short, c["storm"], asked, request, F.lit(False) if stale is None else stale), storm=c["storm"])


def forecast_answer(
    df: DataFrame, place: Column, short: Column, hours: Column, unit: Column, daily: Column, days: Column, asked: Column,
    start: Column, end: Column, request: Column, fields: Column, hourly: Column, zone: Column, now: Column, stale: Column | None = None,
) -> DataFrame:
    """df with ``answer`` and ``forecast`` (the report rows), in the form that the request calls for.

    In order: a window of at most 48 hours, hourly, between two dates, framed as the request words it, plain.
    """
    bounded = lambda c: c["first"].isNotNull() & c["last"].isNotNull()
    form = lambda c: (
        F.when(asked <= 48, F.when(F.size(c["rows"]) > 0, "window").otherwise("no rows"))
        .when(hourly, "hourly")
        .when(bounded(c), "dated")
        .when(F.coalesce(c["framed"], F.lit("")) != "", "framed")
        .otherwise("plain")
    )
    df, c = staged(
        df,
        rows=R.forecast_rows(hours, unit, asked),
        first=Q.stamp(start, zone),
        last=Q.stamp(end, zone),
        sentences=R.daily_text(daily, days, fields),
        framed=Q.framing(F.trim(request), place, days, fields),
        form=form,
        plain=lambda c: F.concat(short, F.lit(" forecast: "), c["sentences"]),
        nearest=lambda c: R.nearest_row(c["rows"], F.coalesce(Q.instant(start, F.lit("UTC")), now)),
        text=lambda c: (
            F.when(c["form"] == "window", R.window_text(place, c["rows"], asked, c["first"], c["last"]))
            .when(c["form"] == "no rows", F.concat(short, F.lit(" forecast: no hourly forecast data was returned")))
            .when(c["form"] == "hourly", R.hourly_text(place, c["rows"], days, F.transform(daily, lambda d: d["date"]), fields))
            .when(c["form"] == "dated", R.dated_text(place, Q.window_label(start, end, days), c["first"], c["last"], Q.has_clock(start) | Q.has_clock(end), fields, c["sentences"]))
            .when(c["form"] == "framed", F.concat(c["framed"], F.lit(" "), c["plain"]))
            .otherwise(c["plain"])
        ),
    )
    answer = R.forecast_text(c["text"], R.nearest_text(c["nearest"], fields), hourly, F.lit(False) if stale is None else stale)
    return _answered(df, "answer", answer, forecast=c["rows"])
