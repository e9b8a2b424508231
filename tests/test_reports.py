"""Requests and sentences against literal results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.functions import reports as R
from quillon.functions import requests as Q
from quillon.operators import reports as operators


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(("text", "place"), [
    ("Give me a 7-day hourly weather forecast for Tokyo, Japan, including temperature in Celsius, precipitation probability, and wind speed.", "Tokyo, Japan"),
    ("Tokyo, Japan", "Tokyo, Japan"),
    ("What is the current temperature and 'feels like' temperature in Tokyo, Japan, and what is the forecast for the next 24 hours including any chance of precipitation?", "Tokyo, Japan"),
    ("Are wind speeds over Islamabad strong enough to cause disruptions today?", "Islamabad"),
    ("Forecast at latitude 37.77, longitude -122.41 (San Francisco) please.", "San Francisco"),
    ("weather at location Rio Grande, next week?", "Rio Grande"),
    ("Will it rain?", "Will it rain?"),
    ("  ", None),
    (None, None),
])
def test_place(spark, text, place):
    assert one(spark, p=Q.place(F.lit(text).cast("string"))).p == place


def test_numbers_and_intent(spark):
    t = "temperature forecast for the next 48 hours at latitude 37.7749 and longitude -122.4194"
    r = one(spark, h=Q.hours(F.lit(t)), d=Q.days(F.lit(t)), c=Q.coordinates(F.lit(t)), f=Q.wants_forecast(F.lit(t)))
    assert (r.h, r.d, r.c.lat, r.c.lon, r.f) == (48, 2, 37.7749, -122.4194, True)
    for text, want in (("forecast over the next 24 hours", False), ("3 day outlook", True), ("hourly please", True), ("weather now", False), ("", False)):
        assert one(spark, f=Q.wants_forecast(F.lit(text))).f is want
    assert one(spark, d=Q.days(F.lit("25h")), z=Q.hours(F.lit("0 hours")), c=Q.coordinates(F.lit("coordinates (1.5, -2)"))) == (2, None, (1.5, -2.0))


def test_normalised(spark):
    def of(**fields):
        return one(spark, r=Q.normalised(F.create_map(*(F.lit(x) for p in fields.items() for x in p)))).r

    r = of(city="Tokyo", latitude="35.7", longitude="139.7", start_date="2026-09-03", endDate="2026-09-09", forecast_hours="400")
    assert (r.q, r.lat, r.lon, r.start_time, r.end_time, r.hours, r.days) == ("Tokyo", 35.7, 139.7, "2026-09-03", "2026-09-09", 168, 7)
    r = of(q=" ", question="7-day hourly forecast for Paris, with wind speed.")
    assert (r.q, r.days, r.fields) == ("Paris", 7, "7-day hourly forecast for Paris, with wind speed.")


def test_framing_and_times(spark):
    text = "A forecast for Oslo starting from 2026-08-01, before the cutoff time of 2026-08-02 UTC."
    r = one(spark, f=Q.framing(F.lit(text), F.lit("Oslo"), F.lit(2), F.lit("temperature_2m")), n=Q.framing(F.lit("plain"), F.lit("Oslo"), F.lit(2), F.lit("")))
    assert r.f == "The 2-day hourly weather forecast for Oslo starting from 2026-08-01, including temperature in Celsius, before the cutoff time of 2026-08-02 UTC. Available forecast:" and r.n == ""
    at = lambda t, z: Q.instant(F.lit(t), F.lit(z))
    r = one(spark, a=at("2026-08-26T15:30", "Asia/Tokyo"), b=at("2026-08-26T15:30Z", "Asia/Tokyo"), c=at("2026-08-26T15:30+02:00", "UTC"), d=at("soon", "UTC"), s=Q.stamp(F.lit("soon"), F.lit("UTC")),
            m=Q.stale_first_time(F.lit("at 2026-08-26T01:30:05.250Z and 2026-08-26T09:00Z")))
    text = lambda x: x.strftime("%H:%M")
    assert (text(r.a), text(r.b), text(r.c), r.d, r.s) == ("06:30", "15:30", "13:30", None, "soon")
    assert r.m == "at 2026-08-25T23:30:05.25Z and 2026-08-26T09:00Z"


HOUR = "struct<time:timestamp,temperature:double,precipitation:double,probability:double,wind:double,gust:double,direction:double,dew_point:double,code:int>"


def hours(spark, rows):
    return spark.createDataFrame([(rows,)], f"hours array<{HOUR}>")


def at(hour, day=26):
    return dt.datetime(2026, 8, day, hour)


def test_current_answer(spark):
    rows = [(at(16), 27.1, 0.2, 30.0, None, None, None, None, 80), (at(17), 31.2, 0.4, 66.0, None, None, None, None, 95), (at(18), 29.4, 0.0, 0.0, None, None, None, None, 3)]
    now = F.struct(F.lit(dt.datetime(2026, 8, 26, 15, 30)).alias("time"), F.lit(30.9).alias("temperature"), F.lit(37.0).alias("apparent"), F.lit(0.0).alias("precipitation"), F.lit(3.4).alias("wind"), F.lit(2).alias("code"),
                   F.lit(41.0).alias("humidity"), F.lit(215.0).alias("direction"), F.lit(1004.2).alias("pressure"), F.lit(40.0).alias("cloud"))
    args = (F.lit("Tokyo, Japan"), F.lit("Tokyo"), now, F.lit("m/s"), F.col("hours"))
    assert operators.current_answer(hours(spark, rows), *args).first().answer == (
        "The current temperature in Tokyo, Japan is 30.9C, and it feels like 37.0C. Over the next 24 hours, temperatures range from 27C to 31C, with a chance of scattered showers or thunderstorms,"
        " and precipitation chances ranging from 30% to 66%. As of 2026-08-26T15:30Z."
    )
    values = operators.current_answer(hours(spark, rows), *args).first().current_values
    assert (values.temperature_f, values.wind_speed_kmh, values.wind_direction_compass, values.conditions) == (87.6, 12.2, "SW", "Partly cloudy")
    plain = operators.current_answer(hours(spark, []), *args, F.lit(True)).first().answer
    assert plain.startswith("Tokyo current: 30.9C, 0.0mm, 3.4m/s, partly_cloudy. As of 2026-08-26T15:30Z.") and "cached observation" in plain


def test_storm_answer(spark):
    calm = [(at(0), 25.0, 0.0, 0.0, 3.6, 7.4, 215.0, None, 1), (at(1), 25.4, 0.0, 0.0, 3.5, 7.0, 225.0, None, 2)]
    wild = [(at(h), 20.0, 2.5, 80.0, 14.0, 30.0, 0.0, None, 95) for h in range(6)]

    def answer(rows, request=""):
        return operators.storm_answer(hours(spark, rows), F.lit("Oslo"), F.col("hours"), F.lit("m/s"), F.lit(48), F.lit(request)).first().answer

    assert answer(calm) == (
        "The forecast for Oslo over the next 48 hours predicts sustained winds up to 13 km/h with peak gusts of 26.6 km/h, no precipitation, and a low risk score of 0.17."
        " No thunderstorm conditions were returned in the hourly forecast. No periods with sustained winds above 25 knots are forecast."
    )
    text = answer(wild, "ERA5 winds")
    assert "precipitation up to 2.5 mm per hour, and a elevated risk score of 0.68." in text or "risk score of 0.68" in text
    assert "2026-08-26T03:00Z and other forecast hours. Sustained winds exceed 25 knots during" in text and text.endswith("not supplied by this source.")
    assert "sustained wind data was not returned with peak gust data was not returned, precipitation data was not returned" in answer([])


def test_forecast_answers(spark):
    rows = [(at(h), 25.0, 0.0, 5.0, 1.0, None, None, 20.0, 2) for h in range(3)]
    df = hours(spark, rows)
    r = R.forecast_rows(F.col("hours"), F.lit("m/s"))
    daily = F.array(*(F.struct(F.lit(d).alias("date"), F.lit(h).alias("high"), F.lit(lo).alias("low"), F.lit(c).alias("code"), F.lit(p).alias("probability")) for d, h, lo, c, p in (("2026-08-26", 36.8, 27.1, 63, 65.0), ("2026-08-27", 35.1, 26.4, 2, 10.0))))

    def forecast(hours_asked=None, start=None, end=None, request="", fields=None, hourly=False):
        text = lambda x: F.lit(x).cast("string")
        return operators.forecast_answer(
            df, F.lit("Lahore, Pakistan"), F.lit("Lahore"), F.col("hours"), F.lit("m/s"), daily, F.lit(2), F.lit(hours_asked).cast("int"),
            text(start), text(end), text(request), text(fields), F.lit(hourly), F.lit("UTC"), F.lit(at(1)),
        ).first().answer

    assert forecast() == "Lahore forecast: today high 37C low 27C moderate_rain; tomorrow high 35C low 26C partly_cloudy. Nearest hour 2026-08-26T01:00Z: 25.0C, 0.0mm, 1.0m/s, partly_cloudy."
    assert forecast(48, hourly=True) == "The forecast for the next 48 hours at Lahore, Pakistan is valid through 2026-08-26T02:00Z, with temperatures ranging from 25C to 25C and partly cloudy conditions. No precipitation is expected."
    assert forecast(fields="temperature,precipitation_probability,wind_speed", hourly=True) == (
        "Lahore, Pakistan forecast for 2026-08-26 through 2026-08-27: temperatures range from 25C to 25C; precipitation probability up to 5%; wind speeds up to 3.6 km/h. Hourly data contains 3 rows."
    )
    assert forecast(start="2026-08-26", end="2026-08-27", fields="temperature").startswith("The 2-day hourly weather forecast for Lahore, Pakistan runs from 2026-08-26 through 2026-08-27 UTC. Including temperature in Celsius. today high 37C low 27C moderate_rain precipitation probability 65%; tomorrow")
    assert forecast(start="2026-08-26T00:00", end="2026-08-27T00:00").startswith("The 48-hour hourly weather forecast for Lahore, Pakistan starts from 2026-08-26T00:00:00Z UTC with a cutoff deadline of 2026-08-27T00:00:00Z UTC. ")
    empty = hours(spark, []).select(r.alias("r"))
    assert empty.select(R.hourly_text(F.lit("X"), F.col("r"), F.lit(2), F.array().cast("array<string>"), F.lit(""))).first()[0] == "X forecast: no forecast data was returned"
    assert spark.range(1).select(R.condition_sky(F.lit(0)), R.condition_sky(F.lit(2)), R.condition_sky(F.lit(45))).first()[:] == ("clear skies", "partly cloudy skies", "fog")


def test_total_of_tenths(spark):
    # Ten tenths add up to 0.9999999999999999 in doubles; the total is 1 mm, which is not minimal.
    none = F.lit(None).cast("string")
    row = F.struct(F.lit("2026-08-26T10:00Z").alias("time"), F.lit(20.0).alias("temp_c"), F.lit(0.1).alias("precip_mm"), F.lit("clear").alias("conditions"))
    got = one(spark, n=R.window_text(F.lit("Tokyo"), F.array_repeat(row, 10), F.lit(24), none, none)).n
    assert got.endswith(". Total precipitation is expected to reach 1mm.")
