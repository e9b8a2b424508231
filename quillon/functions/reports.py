"""Measurements of one place, as arrays of hours and days, projected to report rows and put into sentences.

An hour is a struct of time (timestamp) and any of temperature, precipitation, probability, wind, gust, direction, dew_point and
code; a day one of date (text), high, low, code and probability. The arrays hold one request's window (at most 168 hours), so
everything here is an expression on one row: no shuffle, no Python. Missing and non-finite values count as missing.

A sentence reads its rows many times, so rows and values must be columns of the DataFrame by then, not expressions:
operators/reports.py puts the steps one after another.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import requests as Q
from quillon.functions import scalars as S

#: Hours that a sentence lists, and conditions that it names.
LISTED_HOURS, LISTED_CONDITIONS = 4, 3
KMH = 3.6


def tenth(x: Column) -> Column:
    return S.to_fixed1(S.finite(x)).cast("double")


def whole(x: Column) -> Column:
    return S.round_half_up(S.finite(x)).cast("bigint")


def decimal_text(x: Column) -> Column:
    """One decimal, but none if it is 0."""
    return F.regexp_replace(S.to_fixed1(x), r"\.0$", "")


def whole_text(x: Column) -> Column:
    return whole(x).cast("string")


def _values(rows: Column, of) -> Column:
    return F.filter(F.transform(rows, of), lambda x: x.isNotNull())


def _total(values: Column) -> Column:
    """The sum of figures in tenths, to six decimals: ten times 0.1 is 1, not a little less."""
    return F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")), 6)


def _if(test: Column, *parts) -> Column:
    """The parts in one text if the test holds (and is known), else nothing."""
    return F.when(test, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))).otherwise("")


def forecast_rows(hours: Column, unit: Column, most: Column | None = None) -> Column:
    """Report rows of a forecast: the first ``most`` hours, rounded; what is missing stays null."""

    def row(h: Column) -> Column:
        return F.struct(
            Q.minute_text(h["time"]).alias("time"),
            tenth(h["temperature"]).alias("temp_c"),
            tenth(h["precipitation"]).alias("precip_mm"),
            whole(h["probability"]).alias("precip_probability_pct"),
            tenth(S.wind_ms(h["wind"], unit)).alias("wind_ms"),
            tenth(h["dew_point"]).alias("dew_point_c"),
            F.when(h["code"].isNotNull(), S.condition_slug(h["code"])).alias("conditions"),
        )

    return F.transform(hours if most is None else F.slice(hours, F.lit(1), F.coalesce(most, F.size(hours))), row)


def storm_rows(hours: Column, unit: Column, most: Column | None = None) -> Column:
    """Report rows of a storm outlook: speeds in m/s, km/h and knots, direction, thunder."""

    def speeds(name: str, x: Column) -> list[Column]:
        speed = S.finite(S.wind_ms(x, unit))
        return [tenth(speed).alias(f"{name}_ms"), tenth(speed * KMH).alias(f"{name}_kmh"), tenth(speed * S.KNOTS_PER_MS).alias(f"{name}_knots")]

    def row(h: Column) -> Column:
        return F.struct(
            Q.minute_text(h["time"]).alias("time"),
            tenth(h["temperature"]).alias("temp_c"),
            tenth(h["precipitation"]).alias("precip_mm"),
            whole(h["probability"]).alias("precip_probability_pct"),
            *speeds("wind", h["wind"]),
            *speeds("gust", h["gust"]),
            whole(h["direction"]).alias("wind_direction_deg"),
            S.compass_point(S.finite(h["direction"])).alias("wind_direction_compass"),
            h["code"].alias("weather_code"),
            F.when(h["code"].isNotNull(), S.condition_slug(h["code"])).alias("conditions"),
            h["code"].between(95, 99).alias("thunderstorm"),
        )

    return F.transform(hours if most is None else F.slice(hours, F.lit(1), F.coalesce(most, F.size(hours))), row)


def current_values(c: Column, unit: Column) -> Column:
    """The scalars of a current observation, rounded and converted."""
    wind = S.finite(S.wind_ms(c["wind"], unit))
    return F.struct(
        tenth(c["temperature"]).alias("temperature_c"),
        tenth(S.fahrenheit(c["temperature"])).alias("temperature_f"),
        tenth(c["apparent"]).alias("apparent_temperature_c"),
        whole(c["humidity"]).alias("relative_humidity_pct"),
        tenth(c["precipitation"]).alias("precipitation_mm"),
        tenth(wind).alias("wind_speed_ms"),
        tenth(wind * KMH).alias("wind_speed_kmh"),
        whole(c["direction"]).alias("wind_direction_deg"),
        S.compass_point(S.finite(c["direction"])).alias("wind_direction_compass"),
        tenth(c["pressure"]).alias("surface_pressure_hpa"),
        whole(c["cloud"]).alias("cloud_cover_pct"),
        c["code"].alias("weather_code"),
        F.when(c["code"].isNotNull(), S.condition_phrase(c["code"])).alias("conditions"),
        F.when(c["code"].isNotNull(), S.condition_slug(c["code"])).alias("condition_slug"),
        c["time"].alias("observed_at"),
    )


def condition_of(codes: Column) -> Column:
    """The condition that stands for an array of codes, the most severe first."""
    some = lambda test: F.coalesce(F.exists(codes, test), F.lit(False))
    return (
        F.when(some(S.is_precipitation) & some(lambda c: c >= 95), "scattered showers or thunderstorms")
        .when(some(S.is_precipitation), "rain or showers")
        .when(some(lambda c: c.isin(45, 48)), "fog")
        .when(some(lambda c: c == 3), "overcast")
        .when(some(lambda c: c == 2), "partly cloudy")
        .when(some(lambda c: c == 1), "mainly clear")
        .when(some(lambda c: c == 0), "clear")
    )


def condition_sky(code: Column) -> Column:
    """The condition's phrase as it stands in a sentence: clear skies, partly cloudy skies, fog."""
    text = F.lower(S.condition_phrase(code))
    return F.when(text.endswith(" sky"), F.regexp_replace(text, " sky$", " skies")).when(text.rlike("(clear|cloudy|overcast)$"), F.concat(text, F.lit(" skies"))).otherwise(text)


def horizon(hours: Column, start: Column) -> Column:
    """Lows, highs, condition and chances of the 24 hours from start, both ends included; all hours without a start. Null without hours."""
    near = F.filter(hours, lambda h: h["time"].isNotNull() & (start.isNull() | h["time"].between(start, start + F.expr("INTERVAL 24 HOURS"))))
    temperatures = _values(near, lambda h: S.finite(h["temperature"]))
    wet = F.coalesce(F.exists(near, lambda h: S.is_precipitation(h["code"])), F.lit(False))
    chances = _values(F.filter(near, lambda h: ~wet | F.coalesce(S.is_precipitation(h["code"]), F.lit(False))), lambda h: S.finite(h["probability"]))
    found = F.struct(
        F.array_min(temperatures).alias("low_c"),
        F.array_max(temperatures).alias("high_c"),
        condition_of(_values(near, lambda h: h["code"])).alias("condition"),
        F.array_min(chances).alias("probability_min_pct"),
        F.array_max(chances).alias("probability_max_pct"),
    )
    return F.when(F.size(near) > 0, found)


def place_name(name: Column, country: Column, label: Column) -> Column:
    name, country = S.clean(name), S.clean(country)
    return F.when(name.isNotNull() & country.isNotNull(), F.concat_ws(", ", name, country)).otherwise(F.coalesce(name, label))


_CACHED = " This is the most recent cached {} because the live weather service is temporarily unavailable."


def current_text(place: Column, short: Column, c: Column, unit: Column, ahead: Column, stale: Column) -> Column:
    """The answer for a current observation: temperature and the 24 hours ahead, or, without either, a plain list of values."""
    t = S.finite(c["temperature"])
    spread = ahead["low_c"].isNotNull() & ahead["high_c"].isNotNull()
    chances = ahead["probability_min_pct"].isNotNull() & ahead["probability_max_pct"].isNotNull()
    full = F.concat(
        F.lit("The current temperature in "), place, F.lit(" is "), S.to_fixed1(t), F.lit("C"),
        _if(S.finite(c["apparent"]).isNotNull(), ", and it feels like ", S.to_fixed1(S.finite(c["apparent"])), "C"),
        _if(spread, ". Over the next 24 hours, temperatures range from ", whole_text(ahead["low_c"]), "C to ", whole_text(ahead["high_c"]), "C"),
        _if(ahead["condition"].isNotNull(), ", with a chance of ", ahead["condition"]),
        _if(chances, F.when(ahead["condition"].isNotNull(), ", and").otherwise(" with"), " precipitation chances ranging from ",
            whole_text(ahead["probability_min_pct"]), "% to ", whole_text(ahead["probability_max_pct"]), "%"),
    )
    values = F.array(
        F.concat(S.to_fixed1(t), F.lit("C")),
        F.concat(S.to_fixed1(S.finite(c["precipitation"])), F.lit("mm")),
        F.concat(S.to_fixed1(S.finite(S.wind_ms(c["wind"], unit))), F.lit("m/s")),
        F.when(c["code"].isNotNull(), S.condition_slug(c["code"])),
    )
    plain = F.concat(short, F.lit(" current: "), F.array_join(F.array_compact(values), ", "))
    text = F.when(t.isNotNull() & ahead.isNotNull(), full).otherwise(plain)
    return F.concat(text, _if(c["time"].isNotNull(), ". As of ", Q.minute_text(c["time"])), F.lit("."), _if(stale, _CACHED.format("observation")))


def storm_values(rows: Column) -> Column:
    """Peaks, totals, risk and hours of note over storm report rows."""
    peak = lambda name: F.array_max(F.transform(rows, lambda r: r[name]))
    times = lambda test: F.transform(F.filter(rows, lambda r: F.coalesce(test(r), F.lit(False))), lambda r: r["time"])
    thunder = times(lambda r: r["thunderstorm"])
    strong = times(lambda r: r["wind_ms"] > S.HIGH_WIND_MS)
    score = S.risk_score(peak("gust_kmh"), peak("wind_kmh"), peak("precip_probability_pct"), peak("precip_mm"), F.size(thunder) > 0)
    in_ms = lambda x: tenth(x / KMH)
    in_knots = lambda x: tenth(x / 1.852)
    return F.struct(
        score.alias("risk_score"),
        S.risk_label(score).alias("risk_level"),
        (F.size(thunder) > 0).alias("active_storm_systems"),
        thunder.alias("thunderstorm_hours"),
        peak("wind_kmh").alias("sustained_wind_max_kmh"),
        in_ms(peak("wind_kmh")).alias("sustained_wind_max_ms"),
        in_knots(peak("wind_kmh")).alias("sustained_wind_max_knots"),
        peak("gust_kmh").alias("peak_gust_kmh"),
        in_ms(peak("gust_kmh")).alias("peak_gust_ms"),
        in_knots(peak("gust_kmh")).alias("peak_gust_knots"),
        tenth(_total(_values(rows, lambda r: r["precip_mm"]))).alias("precipitation_total_mm"),
        peak("precip_mm").alias("peak_hourly_precipitation_mm"),
        peak("precip_probability_pct").alias("precipitation_probability_max_pct"),
        (F.size(strong) > 0).alias("sustained_above_25_knots"),
        strong.alias("sustained_above_25_knots_hours"),
    )


def _listed(times: Column) -> Column:
    return F.concat(F.array_join(F.slice(times, 1, LISTED_HOURS), ", "), _if(F.size(times) > LISTED_HOURS, " and other forecast hours"))


def storm_text(short: Column, storm: Column, hours: Column, request: Column, stale: Column) -> Column:
    """The answer for a storm outlook, from storm_values()."""
    wind, gust, rain = storm["sustained_wind_max_kmh"], storm["peak_gust_kmh"], storm["peak_hourly_precipitation_mm"]
    thunder, strong = storm["thunderstorm_hours"], storm["sustained_above_25_knots_hours"]
    rain_text = (
        F.when(rain.isNull(), "precipitation data was not returned")
        .when(storm["precipitation_total_mm"] == 0, "no precipitation")
        .otherwise(F.concat(F.lit("precipitation up to "), decimal_text(rain), F.lit(" mm per hour")))
    )
    return F.concat(
        F.lit("The forecast for "), short, F.lit(" over the next "), hours.cast("string"), F.lit(" hours predicts "),
        F.when(wind.isNull(), "sustained wind data was not returned").otherwise(F.concat(F.lit("sustained winds up to "), decimal_text(wind), F.lit(" km/h"))),
        F.lit(" with "),
        F.when(gust.isNull(), "peak gust data was not returned").otherwise(F.concat(F.lit("peak gusts of "), decimal_text(gust), F.lit(" km/h"))),
        F.lit(", "), rain_text, F.lit(", and a "), storm["risk_level"], F.lit(" risk score of "), F.format_number(storm["risk_score"], 2), F.lit("."),
        F.when(F.size(thunder) > 0, F.concat(F.lit(" Thunderstorms are possible during "), _listed(thunder), F.lit(".")))
        .otherwise(" No thunderstorm conditions were returned in the hourly forecast."),
        F.when(wind.isNull(), " The sustained-wind threshold could not be evaluated because hourly wind data was not returned.")
        .when(F.size(strong) > 0, F.concat(F.lit(" Sustained winds exceed 25 knots during "), _listed(strong), F.lit(".")))
        .otherwise(" No periods with sustained winds above 25 knots are forecast."),
        _if(request.rlike(r"(?i)\b(?:100u|100v|era5)\b"), " The returned wind values are 10 m surface forecasts; 100u/100v model-level components are not supplied by this source."),
        _if(stale, _CACHED.format("storm forecast")),
    )


def _codes(rows: Column) -> Column:
    return _values(rows, lambda r: S.condition_code(r["conditions"]))


def window_text(place: Column, rows: Column, hours: Column, start: Column, end: Column) -> Column:
    """The answer for a window of at most two days: spread of temperature, condition, rain in one of three bands."""
    temperatures = _values(rows, lambda r: r["temp_c"])
    rain = _total(_values(rows, lambda r: r["precip_mm"]))
    condition = condition_of(_codes(rows))
    bounds = F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit(" starts from "), start, F.lit(" UTC with a cutoff deadline of "), end, F.lit(" UTC")))
    return F.concat(
        F.lit("The forecast for the next "), hours.cast("string"), F.lit(" hours at "), place,
        F.coalesce(bounds, F.concat(F.lit(" is valid through "), F.element_at(rows, -1)["time"])),
        F.lit(", with "),
        F.when(F.size(temperatures) > 0, F.concat(F.lit("temperatures ranging from "), whole_text(F.array_min(temperatures)), F.lit("C to "), whole_text(F.array_max(temperatures)), F.lit("C")))
        .otherwise("hourly temperature data"),
        _if(condition.isNotNull(), " and ", condition, " conditions"),
        F.lit("."),
        F.when(rain == 0, " No precipitation is expected.")
        .when(rain < 1, F.concat(F.lit(" Minimal precipitation is expected ("), decimal_text(rain), F.lit("mm total).")))
        .otherwise(F.concat(F.lit(" Total precipitation is expected to reach "), decimal_text(rain), F.lit("mm."))),
    )


def hourly_text(place: Column, rows: Column, days: Column, dates: Column, fields: Column) -> Column:
    """The concise answer over an hourly forecast: only the families of values that the request names, all if it names none."""
    want = Q.field_selection(fields)
    temperatures, rain = _values(rows, lambda r: r["temp_c"]), _values(rows, lambda r: r["precip_mm"])
    chances, dew = _values(rows, lambda r: r["precip_probability_pct"]), _values(rows, lambda r: r["dew_point_c"])
    wind = _values(rows, lambda r: r["wind_ms"] * KMH)
    kinds = F.array_distinct(F.transform(_codes(rows), S.coarse_condition))
    spread = lambda what, xs: F.concat(F.lit(f"{what} range from "), decimal_text(F.array_min(xs)), F.lit("C to "), decimal_text(F.array_max(xs)), F.lit("C"))
    has = lambda xs: F.size(xs) > 0
    parts = F.array_compact(
        F.array(
            F.when(want["temperature"] & has(temperatures), spread("temperatures", temperatures)),
            F.when(want["precipitation"], F.when(~has(rain), "precipitation data was not returned").when(_total(rain) == 0, "no precipitation is expected").otherwise(F.concat(F.lit("total precipitation "), decimal_text(_total(rain)), F.lit("mm")))),
            F.when(want["probability"] & has(chances), F.concat(F.lit("precipitation probability up to "), whole_text(F.array_max(chances).cast("double")), F.lit("%"))),
            F.when(want["conditions"] & has(kinds), F.concat(F.lit("conditions include "), F.lower(F.array_join(F.slice(kinds, 1, LISTED_CONDITIONS), ", ")))),
            F.when(want["wind"] & has(wind), F.concat(F.lit("wind speeds up to "), decimal_text(F.array_max(wind)), F.lit(" km/h"))),
            F.when(want["dew_point"] & has(dew), spread("dew points", dew)),
        )
    )
    named = F.array_compact(F.transform(F.slice(dates, F.lit(1), F.greatest(days, F.lit(0))), Q.date_part))
    first = F.coalesce(F.get(named, F.lit(0)), Q.date_part(F.get(rows, F.lit(0))["time"]))
    last = F.coalesce(F.try_element_at(named, F.lit(-1)), Q.date_part(F.try_element_at(rows, F.lit(-1))["time"]))
    period = F.when(first == last, first).when(first.isNotNull() & last.isNotNull(), F.concat(first, F.lit(" through "), last)).otherwise(F.concat(days.cast("string"), F.lit("-day window")))
    text = F.concat(place, F.lit(" forecast for "), period, _if(has(parts), ": ", F.array_join(parts, "; ")), F.lit(". Hourly data contains "), F.size(rows).cast("string"), F.lit(" rows."))
    return F.when(F.size(rows) > 0, text).otherwise(F.concat(place, F.lit(" forecast: no forecast data was returned")))


def daily_text(daily: Column, days: Column, fields: Column) -> Column:
    """today high 20C low 10C slug; tomorrow ...; 2026-08-28 ...: the first days, in one line."""

    def sentence(d: Column, i: Column) -> Column:
        day = F.when(i == 0, "today").when(i == 1, "tomorrow").otherwise(d["date"])
        chance = F.when(S.clean(fields).isNotNull(), F.concat(F.lit("precipitation probability "), whole_text(d["probability"]), F.lit("%")))
        facts = F.array(day, F.concat(F.lit("high "), whole_text(d["high"]), F.lit("C")), F.concat(F.lit("low "), whole_text(d["low"]), F.lit("C")), F.when(d["code"].isNotNull(), S.condition_slug(d["code"])), chance)
        return F.array_join(F.array_compact(facts), " ")

    return F.array_join(F.transform(F.slice(daily, F.lit(1), F.greatest(days, F.lit(0))), sentence), "; ")


def nearest_row(rows: Column, target: Column) -> Column:
    """The report row nearest to the target in time, the earlier of two."""
    off = lambda r: F.abs(F.unix_seconds(Q.instant(r["time"], F.lit("UTC"))) - F.unix_seconds(target))
    nearer = lambda best, r: F.when(best.isNull() | (off(r) < off(best)), r).otherwise(best)
    return F.aggregate(F.slice(rows, 2, 1 << 30), F.get(rows, F.lit(0)), nearer)


def nearest_text(r: Column, fields: Column) -> Column:
    """Nearest hour 2026-08-26T01:00Z: 25.0C, ...: what the nearest report row holds."""
    facts = F.array(
        F.concat(S.to_fixed1(r["temp_c"]), F.lit("C")),
        F.concat(S.to_fixed1(r["precip_mm"]), F.lit("mm")),
        F.when(S.clean(fields).isNotNull(), F.concat(whole_text(r["precip_probability_pct"].cast("double")), F.lit("% precipitation probability"))),
        F.concat(S.to_fixed1(r["wind_ms"]), F.lit("m/s")),
        r["conditions"],
    )
    return F.concat(F.lit(". Nearest hour "), r["time"], F.lit(": "), F.array_join(F.array_compact(facts), ", "))


def forecast_text(text: Column, nearest: Column, hourly: Column, stale: Column) -> Column:
    """The text, with the nearest hour unless hourly, and one full stop at its end."""
    text = F.concat(text, F.when(F.coalesce(hourly, F.lit(False)), "").otherwise(F.coalesce(nearest, F.lit(""))))
    return F.concat(F.regexp_replace(text, r"\.$", ""), F.lit("."), _if(stale, _CACHED.format("forecast")))


def dated_text(place: Column, label: Column, first: Column, last: Column, clock: Column, fields: Column, sentences: Column) -> Column:
    """The answer for a request with a start and an end."""
    bounds = F.when(clock, F.concat(F.lit(" starts from "), first, F.lit(" UTC with a cutoff deadline of "), last)).otherwise(F.concat(F.lit(" runs from "), first, F.lit(" through "), last))
    return F.concat(F.lit("The "), label, F.lit(" for "), place, bounds, F.lit(" UTC."), Q.including(fields), F.lit(" "), sentences)
