"""Typed facts in short weather texts: extraction, scopes, pairing and penalties, in two lanes.

A fact is a figure with its kind, qualifier, unit, up to three context words and, in the forecast lane, the date that it stands
under. Everything is found by patterns over the bytes of a text; windows around a figure are counted in bytes. ``adjustment`` is
what the composite score adds to the lexical blend. The caps on facts, conditions, dates and durations are the lanes' own.

The column functions at the end run over Arrow batches; equal texts in a batch are read once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.tables import CONDITIONS

# The words of each kind, in the order in which kinds are tried, and whether a unit decides by itself.
TEMPERATURE, HUMIDITY, CLOUD = ("temperature", "temp", "feeling", "feels", "heat", "dewpoint"), ("humidity", "humid"), ("cloud", "overcast")
PROBABILITY, PRECIPITATION = ("chance", "probability", "likelihood"), ("precipitation", "rain", "snow", "drizzle")
WIND, PRESSURE = ("wind", "gust", "bearing"), ("pressure", "barometric")
SPEEDS = ("m/s", "km/h", "mph")
HIGH, LOW, APPARENT = ("high", "maximum", "max"), ("low", "minimum", "min"), ("apparent", "feels", "feeling")
STOP = "a an and as at by for from in is of on or the to with".split()
FORECAST_STOP = "weather forecast current hourly daily today tomorrow yesterday degrees".split()
UNIT_WORDS = "c f hpa km m mm mph s".split()
MONTHS = "january february march april may june july august september october november december".split()
RELATIVE = "today tomorrow yesterday monday tuesday wednesday thursday friday saturday sunday".split()
_SLUGS = {code: slug for code, _, slug in CONDITIONS}
WET = {"check": [*"rain rains rainy drizzle drizzles shower showers snow hail thunderstorm thunderstorms".split(), *(s for c, s in _SLUGS.items() if c > 50 and c != 95)],
       "forecast": "rain rains rainy drizzle drizzles shower showers snow hail thunderstorm thunderstorms light_rain moderate_rain heavy_rain light_drizzle moderate_drizzle thunderstorm_with_slight_hail thunderstorm_with_heavy_hail".split()}
CLEAR = {"check": "clear mainly_clear sunny sunshine".split(), "forecast": "clear sunny sunshine mainly_clear mostly_clear".split()}
CLOUDY = {"check": "overcast cloudy cloud clouds partly_cloudy fog mist depositing_rime_fog".split(), "forecast": "overcast cloudy cloud clouds partly_cloudy fog mist".split()}
SIGNAL = {"check": [*"weather forecast temperature humidity precipitation wind rain snow cloud cloudy overcast thunderstorm celsius fahrenheit".split(), *(s for c, s in _SLUGS.items() if c < 95)],
          "forecast": "weather forecast temperature precipitation precip wind rain drizzle thunderstorm celsius fahrenheit".split()}
COORDINATE = "coordinate coordinates latitude longitude lat lon".split()
GENERIC_PLACE = "a an area coordinate coordinates given location specified the".split()
NOT_A_PLACE = "a an and at before beginning by coordinates each ending for from including latitude location longitude next the with weather forecast temperature precipitation probability hourly daily".split()
OBSERVED = "observed updated issued valid as_of as".split()

# Per kind the largest difference of each step, its penalty, and the further penalty where both texts have the same facts.
STEPS = {
    "check": {
        "temperature": (((0.5, 0.0), (2.0, -0.01), (None, -0.08)), 0.05), "humidity": (((5.0, 0.0), (None, -0.06)), 0.02), "cloud": (((5.0, 0.0), (None, -0.06)), 0.02),
        "probability": (((10.0, 0.0), (None, -0.03)), 0.03), "wind": (((2.0, 0.0), (None, -0.035)), 0.05), "direction": (((22.5, 0.0), (None, -0.05)), 0.04),
        "precipitation": (((1.0, 0.0), (None, -0.035)), 0.03), "pressure": (((5.0, 0.0), (None, -0.018)), 0.02),
    },
    "forecast": {
        "temperature": (((0.5, 0.0), (2.0, -0.01), (None, -0.08)), 0.05), "humidity": (((5.0, 0.0), (None, -0.05)), 0.025), "probability": (((10.0, 0.0), (None, -0.04)), 0.035),
        "wind": (((2.0, 0.0), (None, -0.04)), 0.05), "precipitation": (((1.0, 0.0), (None, -0.04)), 0.035),
    },
}
OTHER_WIND_UNIT, SIGN_FLIP, INCONSISTENT, RANGE = -0.08, -0.12, -0.10, -0.08
FAR_COORDINATES, OTHER_PLACE, NO_PLACE = -0.30, -0.30, -0.12
CONDITION = {"check": -0.18, "forecast": (-0.18, -0.08)}
STALE = {"check": (-0.15, -0.18), "forecast": -0.16}
DATE, MOST_DATE_MISSES, DURATION, MOST_DURATION_MISSES = -0.025, 4, -0.12, 3
BOUNDS = {"check": (-0.40, 0.12), "forecast": (-0.45, 0.0)}
MOST_FACTS, BACK, AHEAD = {"check": 48, "forecast": 128}, {"check": 56, "forecast": 96}, {"check": 40, "forecast": 48}
COORDINATE_BACK, SCOPE_BACK, RELATIVE_BACK, NEGATION_BACK, OBSERVED_BACK = {"check": 64, "forecast": 72}, 144, 96, 28, 56
MOST_CONDITIONS, MOST_DATES, MOST_DURATIONS, MOST_DURATION = 32, 32, 16, 168

_W = rb"[A-Za-z0-9_\x80-\xff]"


@lru_cache(maxsize=256)
def _words(*words: str) -> re.Pattern:
    """Any of the words, whole, in any case."""
    return re.compile(rb"(?<!%s)(?:%s)(?!%s)" % (_W, "|".join(sorted(words, key=len, reverse=True)).encode(), _W), re.IGNORECASE)


@lru_cache(maxsize=256)
def _bytes(*words: str) -> tuple[bytes, ...]:
    return tuple(w.encode() for w in words)


def _has(text: bytes, words) -> bool:
    """Whether one of the words stands in the text, whole; the pattern runs only where its letters are there at all."""
    return _somewhere(text.lower(), _bytes(*words)) and _words(*words).search(text) is not None


def _somewhere(low: bytes, parts: tuple[bytes, ...]) -> bool:
    for part in parts:  # noqa: SIM110 (a generator costs more than the search)
        if part in low:
            return True
    return False


_NUMBER = re.compile(rb"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)")
_WORD = re.compile(_W + rb"+")
_CONTEXT = re.compile(rb"[A-Za-z_]+")
_DEGREE = rb"\xc2\xb0"
#: Unit after a figure, the first that matches; the check lane knows C and F only after a degree sign.
_UNITS = {
    "check": [("%", rb"%"), ("F", _DEGREE + rb"[fF]"), ("C", _DEGREE + rb"[cC]"), ("deg", _DEGREE), ("mm", rb"mm"), ("km/h", rb"km/h"), ("mph", rb"mph"), ("m/s", rb"m/s"), ("hpa", rb"hpa")],
    "forecast": [("%", rb"%"), ("C", rb"(?:%s)?c(?!%s)|%sc" % (_DEGREE, _W, _DEGREE)), ("F", rb"(?:%s)?f(?!%s)|%sf" % (_DEGREE, _W, _DEGREE)), ("K", rb"(?:%s)?k(?!%s)" % (_DEGREE, _W)),
                 ("mm", rb"mm"), ("km/h", rb"km/h"), ("mph", rb"mph"), ("m/s", rb"m/s"),
                 ("C", rb"degrees\s*(?:%s)?(?:celsius|c)(?![A-Za-z_])" % _DEGREE), ("F", rb"degrees\s*(?:%s)?(?:fahrenheit|f)(?![A-Za-z_])" % _DEGREE), ("K", rb"degrees\s*(?:%s)?(?:kelvin|k)(?![A-Za-z_])" % _DEGREE)],
}
_UNIT_AFTER = {lane: [(u, re.compile(rb"[ \t\n\r\x0c]*(?:%s)" % p, re.IGNORECASE)) for u, p in units] for lane, units in _UNITS.items()}
_BARE_DEGREES = re.compile(rb"[ \t\n\r\x0c]*[cf](?!%s)" % _W, re.IGNORECASE)


@dataclass(frozen=True, slots=True)
class Scope:
    """The date (days from 1970), hour and relative label that something stands under; 0, -1 and nothing where unknown."""

    day: int = 0
    hour: int = -1
    label: bytes = b""

    def same(self, other: Scope) -> bool:
        """Unknown goes with anything; dates by day, and by hour where both have one; else equal labels."""
        if self == NOWHERE or other == NOWHERE:
            return True
        if self.day and other.day:
            return self.day == other.day and (self.hour < 0 or other.hour < 0 or self.hour == other.hour)
        return bool(self.label) and self.label == other.label


NOWHERE = Scope()


@dataclass(frozen=True, slots=True)
class Fact:
    kind: str
    qualifier: str
    unit: str
    value: float
    context: tuple[bytes, ...]
    scope: Scope = NOWHERE

    def matches(self, other: Fact) -> bool:
        return bool(self.context) and (self.kind, self.qualifier, self.context) == (other.kind, other.qualifier, other.context) and self.scope.same(other.scope)


def _encoded(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode()


def day_number(year: int, month: int, day: int) -> int:
    """Days from 1970-01-01 of a date; days up to 31 of any month run on into the next month."""
    moved = year - (month <= 2)
    before = 365 * moved + moved // 4 - moved // 100 + moved // 400
    return before + (153 * ((month + 9) % 12) + 2) // 5 + day - 1 - 719_468


_STAMP = re.compile(rb"(?<!%s)([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2}))?" % _W)
_NAMED = re.compile(rb"(?<!%s)(%s)(?!%s)[^A-Za-z0-9_\x80-\xff]*([0-9]+(?:\.[0-9]*)?)[^A-Za-z0-9_\x80-\xff]*([0-9]+(?:\.[0-9]*)?)" % (_W, "|".join(MONTHS).encode(), _W), re.IGNORECASE)


def _stamp(m: re.Match) -> tuple[Scope, int | None] | None:
    """The scope and, for a time of day, the minute of a date in digits."""
    y, mo, d = int(m[1]), int(m[2]), int(m[3])
    if not (1 <= mo <= 12 and 1 <= d <= 31 and y >= 1970):
        return None
    timed = m[4] is not None and int(m[4]) <= 23 and int(m[5]) <= 59
    return Scope(day_number(y, mo, d), int(m[4]) if timed else -1), int(m[5]) if timed else None


#: Each date has a year, which takes four digits; each relative label has one of these.
_YEAR, _RELATIVE_PARTS = re.compile(rb"[0-9]{4}"), (b"day", b"tomorrow")


def scopes(raw: bytes) -> list[tuple[int, Scope]]:
    """Where each date stands, by digits or by a month's name, in order."""
    if not _YEAR.search(raw):
        return []
    found = [(m.start(), s[0]) for m in _STAMP.finditer(raw) if (s := _stamp(m))]
    for m in _NAMED.finditer(raw):
        d, y = float(m[2]), float(m[3])
        if 1 <= d <= 31 and 1970 <= y <= 2200 and y == int(y):
            found.append((m.start(), Scope(day_number(int(y), MONTHS.index(m[1].lower().decode()) + 1, int(d)))))
    return sorted(found, key=lambda x: x[0])


def scope_before(raw: bytes, position: int, marks: list[tuple[int, Scope]]) -> Scope:
    """The last date in the 144 bytes before a position, else the last of today, monday and so on in the 96 bytes before."""
    near = [s for at, s in marks if position - SCOPE_BACK <= at < position]
    if near:
        return near[-1]
    before = raw[max(0, position - RELATIVE_BACK) : position]
    low = before.lower()
    named = _words(*RELATIVE).findall(before) if _somewhere(low, _RELATIVE_PARTS) else []
    return Scope(label=named[-1].lower()) if named else NOWHERE


def _unit(raw: bytes, at: int, lane: str) -> str:
    return next((u for u, p in _UNIT_AFTER[lane] if p.match(raw, at)), "")


def _kind(unit: str, near: bytes, raw: bytes, after: int, lane: str) -> str | None:
    has = lambda words: _has(near, words)
    if lane == "forecast":
        if unit in ("C", "F", "K"):
            return "temperature"
        if unit == "%":
            return "humidity" if has(HUMIDITY) else "probability" if has(PROBABILITY) else None
        if unit == "mm":
            return "precipitation" if has((*PRECIPITATION, "precip")) else None
        return "wind" if unit in SPEEDS else None
    order: tuple[tuple[str, Callable[[], bool]], ...] = (
        ("temperature", lambda: unit in ("C", "F") or bool(_BARE_DEGREES.match(raw, after)) or has(TEMPERATURE)),
        ("humidity", lambda: unit == "%" and has(HUMIDITY)),
        ("cloud", lambda: unit == "%" and has(CLOUD)),
        ("probability", lambda: unit == "%" and has(PROBABILITY)),
        ("precipitation", lambda: has(PRECIPITATION)),
        ("wind", lambda: unit in SPEEDS or has(WIND)),
        ("pressure", lambda: unit == "hpa" or has(PRESSURE)),
    )
    return next((kind for kind, test in order if test()), None)


#: Each word of a qualifier has one of these.
_QUALIFIER_PARTS = (b"high", b"max", b"low", b"min", b"apparent", b"feel")


def _qualifier(near: bytes, lane: str) -> str:
    if not _somewhere(near.lower(), _QUALIFIER_PARTS):
        return ""
    more = (("highest",), ("lowest",)) if lane == "forecast" else ((), ())
    return "high" if _has(near, (*HIGH, *more[0])) else "low" if _has(near, (*LOW, *more[1])) else "apparent" if _has(near, APPARENT) else ""


_DULL = {lane: frozenset(w.encode() for w in (*STOP, *UNIT_WORDS, *more)) for lane, more in (("check", ()), ("forecast", (*FORECAST_STOP, "k")))}


def _context(raw: bytes, start: int, end: int, lane: str) -> tuple[bytes, ...]:
    """The last two words before a figure and the first one after it, but for words that say nothing."""
    dull = _DULL[lane]
    before = [w for w in (m.lower() for m in _CONTEXT.findall(raw, max(0, start - BACK[lane]), start)) if w not in dull][-2:]
    after = _CONTEXT.search(raw, end, min(len(raw), end + AHEAD[lane]))
    return (*before, *([after[0].lower()] if after and after[0].lower() not in dull else ()))


#: Texts of which a worker keeps what it read: a text is often another one's reference, and follows it closely.
KEPT_TEXTS = 16


def facts(text: str | bytes | None, lane: str = "check") -> list[Fact]:
    return list(_facts(_encoded(text), lane))


@lru_cache(maxsize=KEPT_TEXTS)
def _facts(raw: bytes, lane: str) -> list[Fact]:
    found = []
    marks = scopes(raw) if lane == "forecast" else []
    for m in _NUMBER.finditer(raw):
        start, end = m.span()
        unit, near = _unit(raw, end, lane), raw[max(0, start - BACK[lane]) : end + AHEAD[lane]]
        kind = _kind(unit, near, raw, end, lane)
        if kind:
            found.append(Fact(kind, _qualifier(near, lane), unit, float(m[0]), _context(raw, start, end, lane), scope_before(raw, start, marks) if lane == "forecast" else NOWHERE))
            if len(found) == MOST_FACTS[lane]:
                break
    return found


def normal(f: Fact) -> float:
    """Degrees Celsius, metres per second, or the figure."""
    return {"F": (f.value - 32) * 5 / 9, "K": f.value - 273.15, "km/h": f.value / 3.6, "mph": f.value * 0.44704}.get(f.unit, f.value)


def difference(a: Fact, b: Fact) -> float:
    gap = abs(normal(a) - normal(b))
    return 360 - gap if a.kind == "direction" and gap > 180 else gap


def penalty(a: Fact, b: Fact, lane: str = "check") -> float:
    if a.kind != b.kind:
        return 0.0
    if a.kind == "wind" and a.unit and b.unit and a.unit != b.unit:
        return OTHER_WIND_UNIT
    cost = next(c for most, c in STEPS[lane][a.kind][0] if most is None or difference(a, b) <= most)
    if lane == "forecast" and a.kind == "temperature" and cost == -0.08 and normal(a) * normal(b) < 0:
        return SIGN_FLIP
    return cost


def by_context(reference: list[Fact], other: list[Fact]) -> tuple[list[tuple[Fact, Fact]], list[Fact], list[Fact]]:
    """Pairs of matching facts, each reference fact with the first match still free, and what is left on both sides."""
    free, made, rest = list(range(len(other))), [], []
    for r in reference:
        at = next((i for i in free if r.matches(other[i])), None)
        if at is None:
            rest.append(r)
        else:
            free.remove(at)
            made.append((r, other[at]))
    return made, rest, [other[i] for i in free]


def pairs(reference: list[Fact], other: list[Fact], lane: str = "check") -> list[tuple[Fact, Fact]]:
    """Matching facts, then by position what is left of a kind (in the forecast lane: of a kind and qualifier), if equally many."""
    made, ours, theirs = by_context(reference, other)
    key = (lambda f: (f.kind, f.qualifier)) if lane == "forecast" else (lambda f: f.kind)
    for k in dict.fromkeys(map(key, ours)):
        a, b = [f for f in ours if key(f) == k], [f for f in theirs if key(f) == k]
        if len(a) == len(b):
            made += zip(a, b, strict=True)
    return made


def same_shape(reference: list[Fact], other: list[Fact]) -> bool:
    return bool(reference) and len(reference) == len(other) and not by_context(reference, other)[1]


def strict_penalty(reference: list[Fact], other: list[Fact], lane: str = "check") -> float:
    """The further penalty for facts that match by context but not by value."""
    return -sum(STEPS[lane][a.kind][1] for a, b in by_context(reference, other)[0] if penalty(a, b, lane) < 0)


def inconsistent(found: list[Fact], lane: str = "check") -> bool:
    """Whether one temperature is given in two units that are over a degree apart."""
    temps = [f for f in found if f.kind == "temperature"]
    together = (lambda a, b: a.scope.same(b.scope) and a.context == b.context != ()) if lane == "forecast" else (lambda a, b: True)
    return any(a.qualifier == b.qualifier and a.unit != b.unit and together(a, b) and abs(normal(a) - normal(b)) > 1 for i, a in enumerate(temps) for b in temps[:i])


def out_of_range(found: list[Fact]) -> bool:
    """Whether a high is below a low of the same scope."""
    temps = {q: [f for f in found if f.kind == "temperature" and f.qualifier == q] for q in ("high", "low")}
    return any(h.scope.same(x.scope) and normal(h) < normal(x) for h in temps["high"] for x in temps["low"])


def condition_counts(raw: bytes) -> tuple[int, int, int]:
    """How many words speak of wet, clear and cloudy weather."""
    return tuple(len(_words(*lists["check"]).findall(raw)) for lists in (WET, CLEAR, CLOUDY))


def _leading(counts: tuple[int, int, int]) -> int:
    return next((i + 1 for i, n in enumerate(counts) if n), 0)


_SIDES = {w.encode(): i for i, lists in reversed(list(enumerate((WET, CLEAR, CLOUDY), 1))) for w in lists["forecast"]}


def conditions(raw: bytes) -> list[tuple[int, Scope]]:
    """Forecast lane: wet (1), clear (2) or cloudy (3) with its scope, repeats under one scope left out; a negated wet word is clear."""
    return list(_conditions(raw))


@lru_cache(maxsize=KEPT_TEXTS)
def _conditions(raw: bytes) -> list[tuple[int, Scope]]:
    marks, out = scopes(raw), []
    for m in _WORD.finditer(raw):
        side = _SIDES.get(m[0].lower(), 0)
        if side == 1 and _has(raw[max(0, m.start() - NEGATION_BACK) : m.start()], ("no", "not", "without", "none")):
            side = 2
        scope = scope_before(raw, m.start(), marks) if side else NOWHERE
        if side and len(out) < MOST_CONDITIONS and not (out and out[-1][0] == side and out[-1][1].same(scope)):
            out.append((side, scope))
    return out


def condition_penalty(reference: bytes, other: bytes, lane: str, strict: bool) -> float:
    if lane == "check":
        if not strict:
            return 0.0
        a, b = condition_counts(reference), condition_counts(other)
        swapped = (a[0] > b[0] and b[1] > a[1]) or (a[1] > b[1] and b[0] > a[0])
        p, q = _leading(a), _leading(b)
        return CONDITION[lane] * (swapped + bool(p and q and p != q))
    ours, theirs, total = conditions(reference), conditions(other), 0.0
    if len(ours) == len(theirs):
        for side, scope in ours:
            at = next((i for i, (_, s) in enumerate(theirs) if scope.same(s)), None)
            if at is not None:
                found = theirs.pop(at)[0]
                total += 0.0 if found == side else CONDITION[lane][0 if 2 in (side, found) else 1]
    return total


_PAIR = {lane: re.compile(rb"[ \t\n\r\x0c]*%s[,;][ \t\n\r\x0c]*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))" % sign) for lane, sign in (("check", b""), ("forecast", rb"(?:%s[ \t\n\r\x0c]*%s?)?" % (_DEGREE, _W)))}


def coordinates(text: str | bytes | None, lane: str = "check") -> tuple[float, float] | None:
    """The first pair of a latitude and a longitude with a word such as "coordinates" shortly before."""
    raw = _encoded(text)
    if not _somewhere(raw.lower(), _bytes(*COORDINATE)):
        return None
    for m in _NUMBER.finditer(raw):
        lat, near = float(m[0]), raw[max(0, m.start() - COORDINATE_BACK[lane]) : m.start()]
        if -90 <= lat <= 90 and _has(near, COORDINATE) and (after := _PAIR[lane].match(raw, m.end())) and -180 <= (lon := float(after[1])) <= 180:
            return lat, lon
    return None


def far_apart(a: tuple[float, float] | None, b: tuple[float, float] | None, most: float = 0.2) -> bool:
    return a is not None and b is not None and (abs(a[0] - b[0]) > most or abs(a[1] - b[1]) > most)


_AFTER_MARKER = re.compile(rb"(?<!%s)(?:in|at|for)(?!%s)(?=[^A-Za-z0-9_\x80-\xff]+(%s+))" % (_W, _W, _W), re.IGNORECASE)
_QUESTION_PLACE = re.compile(rb"(?: (?:in|at)(?!%s)| for(?=[^A-Za-z0-9_\x80-\xff]))([^?!\n]*)" % _W, re.IGNORECASE)


def asked_place(question: bytes, lane: str = "check") -> list[bytes]:
    """The words of the place that a question names after in, at or for: one in the check lane, up to three in the other."""
    if lane == "check":
        m = _QUESTION_PLACE.search(question)
        word = _WORD.search(m[1]) if m else None
        return [word[0].lower()] if word and len(word[0]) >= 3 else []
    dull = _bytes(*NOT_A_PLACE)
    for m in _AFTER_MARKER.finditer(question):
        words = [w.lower() for w in _WORD.findall(question, m.start(1))[:3]]
        if words[0] not in dull:
            return words[: next((i for i, w in enumerate(words) if w in dull), len(words))]
    return []


def place_penalty(question: bytes, reference: bytes, other: bytes, lane: str = "check") -> float:
    """The place asked for is in the reference but not in the answer, which may name another one."""
    expected = asked_place(question, lane)
    present = lambda raw: set(expected) <= {w.lower() for w in _WORD.findall(raw)}
    if not expected or not present(reference) or present(other) or (lane == "forecast" and coordinates(other, lane)):
        return 0.0
    named = [m[1].lower() for m in _AFTER_MARKER.finditer(other)]
    if lane == "check":
        named = [w for w in named if w[:1].isalpha() and w not in {g.encode() for g in GENERIC_PLACE}]
    else:
        named = [w for w in named if w not in {n.encode() for n in NOT_A_PLACE}]
    return OTHER_PLACE if any(w != expected[0] for w in named) else NO_PLACE


_CLOCK = re.compile(rb"(?=([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]([0-9]{2}):([0-9]{2}))")


def observed_at(text: str | bytes | None, lane: str = "check") -> int | None:
    """Seconds of the first time stamp; in the forecast lane of the first after "updated", "as of" and so on, in whole hours."""
    raw = _encoded(text)
    if not _YEAR.search(raw):
        return None
    for m in _CLOCK.finditer(raw):
        found = _stamp(m)
        if found and found[1] is not None and (lane == "check" or _has(raw[max(0, m.start() - OBSERVED_BACK) : m.start()], OBSERVED)):
            return found[0].day * 86_400 + found[0].hour * 3600 + (found[1] * 60 if lane == "check" else 0)
    return None


def is_stale(reference: str | bytes | None, other: str | bytes | None, lane: str = "check") -> bool:
    """Whether the other text's observation is over an hour older."""
    a, b = observed_at(reference, lane), observed_at(other, lane)
    return a is not None and b is not None and a - b > 3600


def dates(text: str | bytes | None) -> list[tuple[int, int]]:
    """Distinct (day from 1970, hour or -1) in order of appearance."""
    return list(dict.fromkeys((s.day, s.hour) for _, s in scopes(_encoded(text))))[:MOST_DATES]


_DURATION = re.compile(rb"([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))[ \t\n\r\x0c]*-?[ \t\n\r\x0c]*(days?|hours?)(?![A-Za-z_])", re.IGNORECASE)


def durations(text: str | bytes | None) -> list[tuple[int, str]]:
    """(n, day or hour) of "3 days" and "48-hour", whole numbers from 1 to 168."""
    raw = _encoded(text)
    if not _somewhere(raw.lower(), (b"day", b"hour")):
        return []
    found = [(float(m[1]), m[2].lower().rstrip(b"s").decode()) for m in _DURATION.finditer(raw)]
    return [(int(n), unit) for n, unit in found if n == int(n) and 1 <= n <= MOST_DURATION][:MOST_DURATIONS]


def date_misses(reference, other) -> int:
    a, b = dates(reference), dates(other)
    return min(MOST_DATE_MISSES, sum(d not in {x for x, _ in b} for d, _ in a)) if len(a) == len(b) else 0


def duration_misses(reference, other) -> int:
    a, b = durations(reference), durations(other)
    return min(MOST_DURATION_MISSES, sum(x != y for x, y in zip(a, b, strict=True))) if len(a) == len(b) else 0


def has_signal(text: str | bytes | None, lane: str = "check") -> bool:
    return _has(_encoded(text), SIGNAL[lane])


TERMS = ("facts", "strict", "units", "range", "conditions", "dates", "durations", "stale", "place", "coordinates")


def terms(question, reference, other, lane: str = "check") -> dict[str, float]:
    """Every term of the adjustment by name; all zero where the texts are equal or one says nothing of the weather."""
    q, a, b = _encoded(question), _encoded(reference), _encoded(other)
    out = dict.fromkeys(TERMS, 0.0)
    if a == b or not has_signal(a, lane) or not has_signal(b, lane):
        return out
    ours, theirs = facts(a, lane), facts(b, lane)
    strict = same_shape(ours, theirs)
    out["facts"] = sum(penalty(x, y, lane) for x, y in pairs(ours, theirs, lane))
    out["strict"] = strict_penalty(ours, theirs, lane) if strict else 0.0
    out["units"] = INCONSISTENT * inconsistent(theirs, lane)
    out["conditions"] = condition_penalty(a, b, lane, strict)
    far = FAR_COORDINATES * far_apart(coordinates(a, lane), coordinates(b, lane))
    place = place_penalty(q, a, b, lane)
    if lane == "check":
        out["stale"] = STALE[lane][strict] * is_stale(a, b, lane)
        out["place"] = place + CONDITION[lane] * (strict and place < 0)
        out["coordinates"] = far
    else:
        out["range"] = RANGE * (strict and out_of_range(theirs))
        out["dates"] = DATE * date_misses(a, b)
        out["durations"] = DURATION * duration_misses(a, b)
        out["stale"] = STALE[lane] * is_stale(a, b, lane)
        if ours and theirs:
            out["place"], out["coordinates"] = place, far
    return out


def adjustment(question, reference, other, lane: str = "check") -> float:
    """The bounded sum of all terms."""
    low, high = BOUNDS[lane]
    return max(low, min(high, sum(terms(question, reference, other, lane).values())))


def _each(returns: str, work) -> Callable[..., Column]:
    """A column function that calls ``work`` once for each distinct row of texts in a batch."""

    def made(*columns: Column) -> Column:
        @F.pandas_udf(returns)
        def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
            known: dict[tuple, object] = {}
            out = []
            for row in zip(first, *rest, strict=True):
                if row not in known:
                    known[row] = work(*row)
                out.append(known[row])
            return pd.Series(out, dtype=object if returns not in ("double", "boolean", "int") else None)

        return run(*columns)

    return made


def fact_rows(text: Column, lane: str = "check") -> Column:
    """An array of facts for each text."""
    row = lambda f: {"kind": f.kind, "qualifier": f.qualifier, "unit": f.unit, "value": f.value, "context": b" ".join(f.context).decode("utf-8", "replace"), "day": f.scope.day, "hour": f.scope.hour}
    return _each("array<struct<kind string, qualifier string, unit string, value double, context string, day int, hour int>>", lambda t: [row(f) for f in facts(t, lane)])(text)


def fact_pairs(reference: Column, other: Column, lane: str = "check") -> Column:
    """An array of the paired facts of two texts: kind, qualifier, both values and the penalty."""
    row = lambda p: {"kind": p[0].kind, "qualifier": p[0].qualifier, "ours": p[0].value, "theirs": p[1].value, "penalty": penalty(*p, lane)}
    return _each("array<struct<kind string, qualifier string, ours double, theirs double, penalty double>>", lambda a, b: [row(p) for p in pairs(facts(a, lane), facts(b, lane), lane)])(reference, other)


def fact_adjustment(question: Column, reference: Column, other: Column, lane: str = "check") -> Column:
    return _each("double", lambda q, a, b: adjustment(q, a, b, lane))(question, reference, other)


def date_rows(text: Column) -> Column:
    """The days of a text, from 1970."""
    return _each("array<int>", lambda t: [d for d, _ in dates(t)])(text)


def duration_rows(text: Column) -> Column:
    """Hours of each duration in a text."""
    return _each("array<int>", lambda t: [n * (24 if u == "day" else 1) for n, u in durations(t)])(text)


def coordinate_pair(text: Column, lane: str = "check") -> Column:
    return _each("struct<lat double, lon double>", lambda t: None if (p := coordinates(t, lane)) is None else {"lat": p[0], "lon": p[1]})(text)


def far_coordinates(a: Column, b: Column, lane: str = "check") -> Column:
    return _each("boolean", lambda x, y: far_apart(coordinates(x, lane), coordinates(y, lane)))(a, b)


def unit_conflict(text: Column, lane: str = "check") -> Column:
    return _each("boolean", lambda t: inconsistent(facts(t, lane), lane))(text)


def range_violation(text: Column, lane: str = "forecast") -> Column:
    return _each("boolean", lambda t: out_of_range(facts(t, lane)))(text)


def stale_answer(reference: Column, other: Column, lane: str = "check") -> Column:
    return _each("boolean", lambda a, b: is_stale(a, b, lane))(reference, other)


def place_cost(question: Column, reference: Column, other: Column, lane: str = "check") -> Column:
    return _each("double", lambda q, a, b: place_penalty(_encoded(q), _encoded(a), _encoded(b), lane))(question, reference, other)


def condition_sides(text: Column) -> Column:
    """How many words speak of wet, clear and cloudy weather."""
    return _each("struct<wet int, clear int, cloudy int>", lambda t: dict(zip(("wet", "clear", "cloudy"), condition_counts(_encoded(t)), strict=True)))(text)


def signal(text: Column, lane: str = "check") -> Column:
    return _each("boolean", lambda t: has_signal(t, lane))(text)
