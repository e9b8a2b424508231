"""What a request asks for, from its named fields and from its prose: place, coordinates, horizon, fields, dates, framing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import scalars as S

# The words that the patterns below are put together from.
TOPICS = ("weather", "forecast", "temperature", "conditions?", "storm", "wind", "severe")
ASKED_FOR = ("forecast", r"storm(?:\s+alert)?", "severe weather", r"wind(?:\s+speeds?)?", "temperature", "conditions?")
ASKED_IN = (r"weather(?:\s+forecast)?", "forecast", r"storm(?:\s+alert)?", "severe weather", r"wind(?:\s+speed)?", "temperature", "conditions?")
ENDERS = ("including", "with", "starting", "beginning", "from", "before", "and", "that", "please", "strong enough", "expected", "should", "today", "tomorrow", r"over\s+the\s+next", r"for\s+the\s+next", "next")
NAMED_ENDERS = ("including", "with", "starting", "beginning", "from", "before", "and", "that", "please", r"over\s+the\s+next", r"for\s+the\s+next", "next", "today", "tomorrow")
LONGER = ("hourly", "daily", "tomorrow", "multi[- ]day", r"\d+\s*[- ]?days?", r"\d+\s*[- ]?hours?")
#: Field families by the words that name them.
FIELD_WORDS = ("temperature", "temp", "2t", "precipitation", "precip", "rain", "snow", "wind", "gust", r"dew\s*point", "weather", "condition", "cloud", "probability", "chance")
CONDITION_WORDS = ("weather", "condition", "cloud", "rain", "snow", "drizzle", "thunderstorm")
MOST_HOURS, MOST_DAYS, DEFAULT_DAYS = 168, 7, 3

_any = "|".join


def _word(words) -> str:
    return rf"\b(?:{_any(words)})\b"


_CAPITALISED = r"[A-Z][A-Za-z.'-]*"
_NAME = rf"({_CAPITALISED}(?:\s+{_CAPITALISED}){{0,4}}(?:,\s*{_CAPITALISED}){{0,2}})"
_END = rf"(?=\s*,?\s*{_word(ENDERS)}|[?!.]|$)"
_NAMED_END = rf"(?=\s*\(|\s*,?\s*{_word(NAMED_ENDERS)}|[?!.]|$)"
_NUMBER = r"(-?\d+(?:\.\d+)?)"


def _group(text: Column, pattern: str, at: int = 1) -> Column:
    """The group of the first match, trimmed; null if there is none or it is blank."""
    return S.clean(F.regexp_extract(text, pattern, at))


def _place_end(found: Column) -> Column:
    """Without a coordinate that follows the name, and without signs at the end."""
    bare = F.regexp_replace(found, r"(?i)\s*\(?\s*\b(?:latitude|lat|longitude|lon)\b.*$", "")
    return S.clean(F.regexp_replace(bare, r"""[,'"]+$""", ""))


def first_present(*fields: Column) -> Column:
    """The first field that has text; an array counts by its first element already taken."""
    return F.coalesce(*(S.clean(f) for f in fields))


def place(text: Column) -> Column:
    """The place that a request names, by the first rule that finds one; the request itself if none does or it is a bare name."""
    t = S.clean(text)
    rules = (
        _group(t, rf"\(\s*{_NAME}\s*\)"),
        _place_end(_group(t, rf"(?i)\blocation\s+{_NAME}{_NAMED_END}")),
        _place_end(_group(t, rf"(?i){_word(ASKED_FOR)}.*\bfor\s+(?!the\s+next\b|next\b)(.+?){_END}")),
        _place_end(_group(t, rf"(?i){_word(ASKED_IN)}\s+(?:for|in|at|over)\s+(.+?){_END}")),
        _place_end(_group(t, rf"(?i)\b(?:for|in|at|over)\s+(.+?){_END}")),
    )
    return F.when(~t.rlike(rf"(?i)[?!.]|{_word(TOPICS)}"), t).otherwise(F.coalesce(*rules, t))


def coordinates(text: Column) -> Column:
    """latitude and longitude, both named anywhere in the text, or as a pair after "coordinates"; null without both."""
    lat, lon = (_group(text, rf"(?i)\b(?:{long}|{short})\s*[:=]?\s*{_NUMBER}") for long, short in (("latitude", "lat"), ("longitude", "lon")))
    pair = rf"(?i)\bcoordinates?\s*[:=]?\s*\(?\s*{_NUMBER}\s*[,/]\s*{_NUMBER}\s*\)?"
    both = lat.isNotNull() & lon.isNotNull()
    lat, lon = (F.when(both, named).otherwise(_group(text, pair, g)).cast("double") for named, g in ((lat, 1), (lon, 2)))
    return F.when(lat.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def hours(text: Column) -> Column:
    """The first "N hours" or "N h"; null for none or for 0."""
    n = _group(text, r"(?i)\b(\d{1,3})\s*[- ]?(?:hours?|h)\b").cast("int")
    return F.when(n > 0, n)


def days(text: Column) -> Column:
    """The first "N days", else the hours in whole days, rounded up."""
    named = _group(text, r"(?i)\b(\d{1,2})\s*[- ]?days?\b").cast("int")
    return F.coalesce(named, F.ceil(hours(text) / 24).cast("int"))


def wants_forecast(text: Column) -> Column:
    """Hourly, daily, tomorrow, several days, hours or "forecast", but for a request over the next 24 hours."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return ~t.rlike(r"\bnext\s+24\s+hours?\b") & t.rlike(_word((*LONGER, "forecast")))


def positive_integer(value: Column) -> Column:
    n = value.try_cast("double")
    return F.when((n > 0) & (n == F.floor(n)), n.cast("int"))


def field_selection(fields: Column) -> Column:
    """Which families of values a request names; all of them if it names none."""
    t = F.regexp_replace(F.lower(F.coalesce(fields, F.lit(""))), "[_-]+", " ")
    none = ~t.rlike(_word(FIELD_WORDS))
    has = lambda *words: t.rlike(_word(words))
    wet = has("precip", "rain", "snow") | t.rlike(r"\bprecipitation\b(?!\s+(?:probability|chance)\b)")
    picked = {"temperature": has("temperature", "temp", "2t"), "precipitation": wet, "probability": has("probability", "chance"), "conditions": has(*CONDITION_WORDS), "wind": has("wind", "gust"), "dew_point": has(r"dew\s*point")}
    return F.struct(*((none | test).alias(name) for name, test in picked.items()))


def date_part(value: Column) -> Column:
    return S.clean(F.regexp_extract(value, r"^\d{4}-\d{2}-\d{2}", 0))


def has_clock(value: Column) -> Column:
    return F.coalesce(value.rlike(r"T\d{2}:\d{2}"), F.lit(False))


def span_days(start: Column, end: Column) -> Column:
    return S.day_span(F.try_to_date(date_part(start)), F.try_to_date(date_part(end)))


def instant(value: Column, zone: Column) -> Column:
    """The instant of an ISO text: by its own offset, else as a local time of the zone; null if it is no time.

    The session's zone must be UTC. A bare date ends like an offset and counts as UTC, as does a text with a Z.
    """
    t = F.regexp_replace(S.clean(value), r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(?!:)", "$1 $2:00")
    zoned = t.rlike(r"[zZ]|[+-]\d\d(?::?\d\d)?$")
    local = F.try_to_timestamp(t)
    moved = F.to_utc_timestamp(local, F.coalesce(S.clean(zone), F.lit("UTC")))
    return F.when(zoned, F.try_to_timestamp(t)).otherwise(moved)


def minute_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm'Z'")


def second_text(at: Column) -> Column:
    """Whole seconds without a fraction, others with milliseconds."""
    whole = F.pmod(F.unix_millis(at), F.lit(1000)) == 0
    return F.when(whole, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def stamp(value: Column, zone: Column) -> Column:
    """A bare date as it is, other times as an instant, what is no time as it is."""
    t = S.clean(value)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).otherwise(F.coalesce(second_text(instant(t, zone)), t))


def window_label(start: Column, end: Column, days: Column) -> Column:
    span, clock = span_days(start, end), has_clock(start) | has_clock(end)
    n = F.when(span.isNotNull() & ~clock, F.concat(span.cast("string"), F.lit("-day"))).when(clock, "48-hour").otherwise(F.concat(days.cast("string"), F.lit("-day")))
    return F.concat(n, F.lit(" hourly weather forecast"))


def window_days(explicit: Column, hours: Column, start: Column, end: Column) -> Column:
    """Days of the window, 1 to 7: two for clock times on one date, else the span of the dates, else what is asked for."""
    span = span_days(start, end)
    asked = F.when(explicit > 0, explicit).when(hours > 0, F.ceil(hours / 24)).otherwise(F.lit(DEFAULT_DAYS))
    one_date = F.when((span == 1) & (has_clock(start) | has_clock(end)) & explicit.isNull(), 2)
    return F.least(F.lit(MOST_DAYS), F.greatest(F.lit(1), F.coalesce(one_date, span, asked))).cast("int")


def fetch_end(start: Column, end: Column) -> Column:
    """The last date to fetch: the end if it is later than the start, else the day after the start."""
    first, last = date_part(start), date_part(end)
    following = F.date_add(F.try_to_date(first), 1).cast("string")
    return F.when(first.isNull(), last).when(last > first, last).otherwise(F.coalesce(following, first))


def including(fields: Column) -> Column:
    """" Including ..." with the named fields, or nothing."""
    terms = S.field_terms(fields)
    return F.when(F.size(terms) > 0, F.concat(F.lit(" Including "), S.joined_terms(terms), F.lit("."))).otherwise("")


def framing(text: Column, place: Column, days: Column, fields: Column) -> Column:
    """The sentence that takes up a start or a cutoff which the request words freely; empty without either."""
    opening = rf"(?i)\bstarting\s+(?:{_any(('from', 'on'))})\s+"
    closing = rf"(?i)\bbefore\s+the\s+cutoff\s+(?:{_any(('time', 'deadline'))})\s+of\s+"
    after = lambda pattern: F.element_at(F.split(text, pattern, 2), 2)
    start = S.clean(F.when(text.rlike(opening), F.element_at(F.split(after(opening), rf"(?i)\s*,|\s+{_word(('including', 'with', 'before'))}|[?!.]", 2), 1)))
    cutoff = S.clean(F.when(text.rlike(closing), F.element_at(F.split(after(closing), "[,?.!]", 2), 1)))
    terms = S.field_terms(fields)
    sentence = F.concat(
        F.lit("The "), days.cast("string"), F.lit("-day hourly weather forecast for "), place,
        F.when(start.isNotNull(), F.concat(F.lit(" starting from "), start)).otherwise(""),
        F.when(F.size(terms) > 0, F.concat(F.lit(", including "), S.joined_terms(terms))).otherwise(""),
        F.when(cutoff.isNotNull(), F.concat(F.lit(", before the cutoff time of "), cutoff)).otherwise(""),
        F.lit(". Available forecast:"),
    )
    return F.when(start.isNotNull() | cutoff.isNotNull(), sentence).otherwise("")


#: The names under which a request may give a value, first come first.
ALIASES = {
    "q": ("q", "location", "city", "place", "query"),
    "text": ("request_text", "question", "prompt", "text"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "longitude"),
    "start_time": ("start_time", "startTime", "start_date", "startDate", "start"),
    "end_time": ("end_time", "endTime", "end_date", "endDate", "end"),
    "hours": ("hours", "forecast_hours", "forecastHours", "horizon_hours", "horizonHours"),
}


def normalised(request: Column) -> Column:
    """One struct from a map of a request's fields (name to text): q, text, lat, lon, days, hours, fields, start_time, end_time."""
    field = lambda name: F.try_element_at(request, F.lit(name))
    asked = {k: first_present(*map(field, names)) for k, names in ALIASES.items() if k != "hours"}
    text = F.coalesce(asked["text"], asked["q"])
    q = F.when(asked["q"].isNotNull() & (asked["q"] != text), asked["q"]).otherwise(place(F.coalesce(asked["q"], text)))
    spoken = coordinates(text)
    n = F.least(F.lit(MOST_HOURS), F.coalesce(*(positive_integer(field(name)) for name in ALIASES["hours"]), hours(text)))
    return F.struct(
        q.alias("q"),
        text.alias("text"),
        F.coalesce(asked["lat"].try_cast("double"), spoken["lat"]).alias("lat"),
        F.coalesce(asked["lon"].try_cast("double"), spoken["lon"]).alias("lon"),
        F.coalesce(field("days").try_cast("int"), F.ceil(n / 24).cast("int"), days(text)).alias("days"),
        n.alias("hours"),
        F.coalesce(S.clean(field("fields")), F.when(wants_forecast(text), text)).alias("fields"),
        asked["start_time"].alias("start_time"),
        asked["end_time"].alias("end_time"),
    )


def valid_position(lat: Column, lon: Column) -> Column:
    """ok, or what is wrong: one without the other, or out of range."""
    return F.when(lat.isNull() != lon.isNull(), "both or neither").when(~lat.between(-90, 90), "latitude").when(~lon.between(-180, 180), "longitude").otherwise("ok")


def stale_first_time(text: Column, hours: int = 2) -> Column:
    """The text with its first time of the form 2026-08-26T10:00Z so many hours earlier, seconds and fraction kept as they stand."""
    found = F.regexp_substr(text, F.lit(r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?Z\b"))
    to_minute, rest = F.substring(found, 1, 16), F.substring(found, 17, 40)
    earlier = F.try_to_timestamp(F.concat(F.regexp_replace(to_minute, "T", " "), F.lit(":00"))) - F.expr(f"INTERVAL {hours} HOURS")
    moved = F.concat(F.date_format(earlier, "yyyy-MM-dd'T'HH:mm"), F.regexp_replace(rest, r"(\.\d*?)0+Z$|\.0+Z$", "$1Z"))
    at = F.position(found, text)
    whole = F.concat(F.substring(text, F.lit(1), at - 1), moved, F.substring(text, at + F.length(found), F.length(text)))
    return F.coalesce(whole, text)
