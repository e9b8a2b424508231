"""Structured Streaming forms of the series operators: horizons, last known values, late rows, repeats and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.functions import scalars as S


def rolling_summary(events: DataFrame, ts: str, key: str, value: str, code: str, late: str = "1 hour", length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Sliding windows with a watermark: extremes, sums and the dominant condition per key."""
    kept = events.withWatermark(ts, late)
    return kept.groupBy(F.window(ts, length, slide), key).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"), S.dominant_condition(F.col(code)).alias("condition")
    )


def session_summary(events: DataFrame, ts: str, key: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def without_repeats(events: DataFrame, ts: str, keys: list[str], within: str = "60 seconds") -> DataFrame:
    """The first row of each key within the time to live, as a result cache would serve it."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def late_rows(events: DataFrame, ts: str, seen: str, limit: str = "1 hour") -> DataFrame:
    """Rows with a mark on those that arrive later than the limit after their own time."""
    return events.withColumn("late", F.col(seen) > F.col(ts) + F.expr(f"INTERVAL {limit}"))


def last_known(events: DataFrame, ts: str, key: str, value: str, late: str = "1 hour") -> DataFrame:
    """Per key and batch the newest value that is not missing, marked stale if it comes from an earlier batch.

    State is one value per key and is dropped when the watermark passes the key's timeout.
    """

    def update(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        fresh = rows[value].dropna()
        known = float(fresh.iloc[-1]) if len(fresh) else (state.get[0] if state.exists else None)
        if known is not None:
            state.update((known,))
            state.setTimeoutTimestamp(max(int(rows[ts].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame({"key": [names[0]], "known": [known], "stale": [not len(fresh)]})

    out = "key " + events.schema[key].dataType.simpleString() + ", known double, stale boolean"
    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(update, out, "known double", "update", GroupStateTimeout.EventTimeTimeout)
