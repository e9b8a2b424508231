"""Typed facts in both lanes against literal results."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import facts as X
from quillon.functions import projection, scoring


def test_kinds_units_and_qualifiers():
    got = X.facts("High of 86°F. " + "-" * 60 + " low 20 °C " + "-" * 60 + " humidity 40%" + "-" * 60 + "wind 12 km/h" + "-" * 60 + "rain 5 mm" + "-" * 60 + "pressure 1013 hPa")
    assert [(f.kind, f.unit, f.value) for f in got] == [("temperature", "F", 86), ("temperature", "C", 20), ("humidity", "%", 40), ("wind", "km/h", 12), ("precipitation", "mm", 5), ("pressure", "hpa", 1013)]
    assert [f.qualifier for f in got][:2] == ["high", "low"] and got[0].context == (b"high",)
    # A word of temperature nearby decides before the unit does, and a bare C is a temperature without a unit.
    assert [(f.kind, f.unit) for f in X.facts("temperature 20C, wind 5 m/s")] == [("temperature", ""), ("temperature", "m/s")]
    got = X.facts("temperature 293 K, 20 degrees Celsius, wind 5 m/s, chance 30%", "forecast")
    assert [(f.kind, f.unit, f.value) for f in got] == [("temperature", "K", 293), ("temperature", "C", 20), ("wind", "m/s", 5), ("probability", "%", 30)]


def test_scopes_and_pairs():
    text = "2026-08-26T10:00Z 20°C and 2026-08-27 25°C, then Monday " + "-" * 150 + " today 30°C"
    got = X.facts(text, "forecast")
    assert [(f.value, f.scope.day, f.scope.hour, f.scope.label) for f in got] == [(20, 20691, 10, b""), (25, 20692, -1, b""), (30, 0, -1, b"today")]
    one, other = X.Scope(5, 3), X.Scope(5, 4)
    assert not one.same(other) and one.same(X.Scope(5)) and one.same(X.NOWHERE) and not one.same(X.Scope(label=b"today"))
    a, b = X.facts("on 2026-08-26 the high is 20°C", "forecast"), X.facts("on 2026-08-27 the high is 20°C", "forecast")
    assert X.by_context(a, b)[0] == [] and len(X.pairs(a, b, "forecast")) == 1  # by position, as one is left on each side
    a = [X.Fact("humidity", "", "%", v, (b"x",)) for v in (1, 2)]
    assert [(p.value, q.value) for p, q in X.pairs(a, a[::-1])] == [(1, 2), (2, 1)]
    assert X.pairs(a, a[:1]) == [(a[0], a[0])]


def test_penalties():
    fact = lambda kind, unit, v, lane="check": X.Fact(kind, "", unit, v, (b"x",))
    assert X.difference(fact("direction", "deg", 355), fact("direction", "deg", 5)) == 10
    assert X.penalty(fact("temperature", "C", 20), fact("temperature", "F", 68)) == 0
    assert [X.penalty(fact("temperature", "C", 0), fact("temperature", "C", v)) for v in (0.5, 2, 2.1)] == [0, -0.01, -0.08]
    assert X.penalty(fact("temperature", "C", -3), fact("temperature", "C", 3), "forecast") == -0.12
    assert X.penalty(fact("wind", "m/s", 5), fact("wind", "km/h", 18)) == -0.08 and X.penalty(fact("wind", "", 5), fact("wind", "km/h", 18)) == 0
    assert X.out_of_range([X.Fact("temperature", "high", "C", 1, ()), X.Fact("temperature", "low", "C", 2, ())])
    assert X.inconsistent(X.facts("20°C (90°F)")) and not X.inconsistent(X.facts("20°C (68°F)"))


def test_dates_durations_times_and_places():
    assert X.dates("1970-01-02, January 3, 1970 and 2024-02-31 at 2024-02-31") == [(1, -1), (2, -1), (X.day_number(2024, 3, 2), -1)]
    assert X.durations("a 3-day trip, 48 hours, 9 days, 200 hours") == [(3, "day"), (48, "hour"), (9, "day")]
    assert X.coordinates("at 52.52, 13.40") is None and X.coordinates("coordinates 52.52, 13.40") == (52.52, 13.40)
    assert X.coordinates("latitude 52.52° N, 13.40", "forecast") == (52.52, 13.40) and X.coordinates("lat 95, 3") is None
    assert X.observed_at("seen 1970-01-02 01:30") == 86_400 + 5400 and X.observed_at("seen 1970-01-02 01:30", "forecast") is None and X.observed_at("as of 1970-01-02T01:30Z", "forecast") == 86_400 + 3600
    assert X.is_stale("2026-08-26T10:01Z", "2026-08-26T09:00Z") and not X.is_stale("2026-08-26T10:00Z", "2026-08-26T09:00Z")
    q = b"What is the weather in Oslo?"
    assert [X.place_penalty(q, b"Rain in Oslo", a) for a in (b"rain in OSLO now", b"rain", b"rain at the area", b"rain in Bergen")] == [0, -0.12, -0.12, -0.30]
    assert X.asked_place(b"hourly forecast for the next days in New York City now", "forecast") == [b"new", b"york", b"city"]


def test_conditions():
    assert X.condition_counts(b"Rain, light_drizzle, partly_cloudy, clear") == (2, 1, 1)
    sides = [s for s, _ in X.conditions(b"rain and showers, then no rain, cloudy")]
    assert sides == [1, 2, 3]
    assert X.condition_penalty(b"clear", b"rain", "forecast", False) == -0.18 and X.condition_penalty(b"cloudy", b"rain", "forecast", False) == -0.08
    assert X.condition_penalty(b"clear", b"rain", "check", False) == 0 and X.condition_penalty(b"clear", b"rain", "check", True) == -0.36


@pytest.mark.parametrize(("other", "want"), [
    ("Temperature 20°C with humidity 60%", 0.0),
    ("Temperature 35°C with humidity 60%", -0.23),
    ("Temperature 21°C with humidity 60%", -0.16),
    ("The committee adjourned", 0.0),
    ("Temperature 35°C", -0.08),
])
def test_adjustment_of_the_check_lane(other, want):
    """The second figure is a temperature too, by the word before it: in another unit and far from the first, that costs 0.10."""
    assert X.adjustment("", "Temperature 20°C with humidity 60%", other) == pytest.approx(want)


def test_adjustment_of_the_forecast_lane():
    terms = X.terms("", "Forecast: rain on 2026-08-26, 48 hours", "Forecast: clear on 2026-08-27, 24 hours", "forecast")
    assert {k: round(v, 3) for k, v in terms.items() if v} == {"conditions": -0.18, "dates": -0.025, "durations": -0.12}
    assert X.adjustment("", "Forecast: rain", "Forecast: rain and more", "forecast") == 0
    assert X.adjustment("", "Forecast: rain 1 day 2 day 3 day", "Forecast: clear 4 hours 5 hours 6 hours", "forecast") == -0.45


def test_composite_and_breakdown():
    truth, wrong = b"Temperature 20\xc2\xb0C with humidity 60%", b"Temperature 35\xc2\xb0C with humidity 60%"
    lexical = scoring.raw_score(b"q", truth, wrong)
    assert scoring.composite(b"q", truth, wrong) == pytest.approx(lexical - 0.23) and scoring.composite(b"q", truth, b" \n") == 0
    got = dict(zip(scoring.FIELDS, scoring.fields(b"humidity now", truth, wrong), strict=True))
    assert got["raw_score"] == pytest.approx(lexical - 0.23) and got["score"] == scoring.score(b"humidity now", truth, wrong)[1]
    assert 0 <= got["relevance"] < got["correctness"] <= 1 and 0 < got["lexical"] < 1 and got["length_quality"] == pytest.approx(1 / (1 + 2.718281828 ** (-(len(wrong) - 50) / 20)))
    assert scoring.fields(b"q", truth, b"")[:5] == (0, 0, 0, 0, 0)
    assert scoring.bm25(truth, truth) > scoring.bm25(truth, wrong) and scoring.bm25(b"\xff", truth) == 0


def test_projection_by_hand():
    """One word: three buckets; a second word adds three more and one for the pair. Written out with plain integers."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def word(w):
        h = 0xCBF29CE484222325
        for c in w:
            h = (h ^ c) * 0x100000001B3 & mask
        return h ^ 0x9E3779B97F4A7C15

    hashes, out = [word(b"rain"), word(b"oslo_2")], [0.0] * 384
    for i, h in enumerate(hashes):
        x = mix(h ^ (i << 32))
        for weight, bucket, sign in ((1.0, 0x11, 0x44), (0.75, 0x22, 0x55), (0.5, 0x33, 0x66)):
            out[mix(x ^ bucket) % 384] += -weight if mix(x ^ sign) & 1 else weight
    pair = mix(((hashes[0] << 17 | hashes[0] >> 47) & mask) ^ hashes[1])
    out[mix(pair ^ 0x77) % 384] += -0.35 if mix(pair ^ 0x88) & 1 else 0.35
    length = sum(x * x for x in out) ** 0.5
    assert projection.project("Rain, OSLO_2!") == pytest.approx([x / length for x in out])
    assert not projection.project("").any() and projection.equal_words("Rain, now", "rain NOW!") and not projection.equal_words("a b", "b a")


def test_coordinates_as_printed(spark, tmp_path):
    # 0.345 lies below the half in binary and prints as 0.34; 0.125 is a true tie and prints as 0.12.
    from quillon.functions import scalars
    from quillon.plans.catalogue import QUERIES

    lat = [(0.345,), (0.125,), (-0.125,), (-0.001,), (1234.5,)]
    got = [r.x for r in spark.createDataFrame(lat, "v double").select(scalars.fixed(F.col("v"), 2).alias("x")).collect()]
    assert got == ["%.2f" % v for v, in lat]
    balances = [69.0, 25.0, 9000.0, 55.0]
    spark.createDataFrame([(2 + 5 * i, b) for i, b in enumerate(balances)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    rows = {r.c_custkey: r.far for r in QUERIES["coord_mismatch"](spark, str(tmp_path)).collect()}
    written = lambda x: float("%.2f" % x)
    assert rows == {2 + 5 * i: abs(written(b / 200) - written(b / 200 + 0.2)) > 0.2 for i, b in enumerate(balances)}


def test_texts_are_read_once(monkeypatch):
    # Each report is the next one's reference: three texts of two figures, not four.
    read, real = [], X._unit
    monkeypatch.setattr(X, "_unit", lambda *a: read.append(a) or real(*a))
    texts = [f"Temperature {t}°C and wind {t} m/s, once read" for t in (11, 12, 13)]
    for a, b in zip(texts, texts[1:], strict=False):
        assert len(X.pairs(X.facts(a, "forecast"), X.facts(b, "forecast"), "forecast")) == 2
    assert len(read) == 6


def test_conditions_are_read_once(monkeypatch):
    read, real = [], X.scope_before
    monkeypatch.setattr(X, "scope_before", lambda *a: read.append(a) or real(*a))
    texts = [f"rain on day {t} of the forecast" for t in (1, 2, 3)]
    for a, b in zip(texts, texts[1:], strict=False):
        assert X.adjustment("", a, b, "forecast") == 0
    assert len(read) == 3
    # What is handed out may be changed by whoever asked for it.
    X.conditions(texts[0].encode()).clear()
    X.facts(texts[0], "forecast").append(None)
    assert len(X.conditions(texts[0].encode())) == 1 and None not in X.facts(texts[0], "forecast")


def test_similarity_keeps_projections_in_the_worker(spark):
    from quillon.functions import vectors
    from quillon.session import ship_package

    ship_package(spark)
    df = spark.createDataFrame([("rain in Oslo", "Oslo: rain, wind"), ("", "x"), (None, None), ("a b c", "a b c")], "a string, b string")
    both = df.select(projection.similarity(F.col("a"), F.col("b")).alias("x"), vectors.cosine(projection.projection(F.col("a")), projection.projection(F.col("b"))).alias("y"))
    assert all(r.x == r.y for r in both.collect())
    plan = df.select(projection.similarity(F.col("a"), F.col("b")))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan
