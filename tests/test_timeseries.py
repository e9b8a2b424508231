"""Time series operators against brute force."""

import datetime as dt
import random

from quillon.operators import timeseries as T


def test_nearest_rows(spark):
    # Equal times, equal distances, empty hours between and whole days outside the rows.
    draw, start = random.Random(3), dt.datetime(2026, 8, 26)
    rows = [(start + dt.timedelta(minutes=draw.choice([0, 5, 30, 55]) + 60 * draw.choice([0, 1, 2, 7, 8, 3000])), i) for i in range(60)] + [(None, 60)]
    asked = [start + dt.timedelta(minutes=30 * i) for i in range(-4, 24)] + [start + dt.timedelta(hours=h) for h in (-5000, 1400, 1600, 3000, 9000)]
    found = T.nearest_rows(spark.createDataFrame([(a,) for a in asked], "hour timestamp"), spark.createDataFrame(rows, "ts timestamp, id long"), "hour", "ts", "id")
    want = {a: min((abs(t - a), t, i) for t, i in rows if t is not None)[2] for a in asked}
    assert {r.hour: r.row.id for r in found.collect()} == want
    # A frame to the partition's end costs the square of its rows.
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
