import json

import pytest

from quillon.sources import captures, tsv


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_fixture_lines_of_both_kinds(spark, tmp_path):
    path = write(tmp_path / "f.tsv", "# note\n\nq1\tt1\tg1\tb1\nq2\\tt2\\tg2\\tb2\n")
    assert [tuple(r) for r in tsv.read_fixtures(spark, path).collect()] == [("q1", "t1", "g1", "b1"), ("q2", "t2", "g2", "b2")]


def test_wrong_arity_and_scores_fail(spark, tmp_path):
    with pytest.raises(Exception, match="without 4 fields"):
        tsv.read_traffic(spark, write(tmp_path / "a.tsv", "only\tthree\tfields\n")).collect()
    with pytest.raises(Exception, match="not a score"):
        tsv.read_champion(spark, write(tmp_path / "b.tsv", "x\t1.5\n")).collect()
    with pytest.raises(ValueError, match="no rows"):
        tsv.require_rows(tsv.read_champion(spark, write(tmp_path / "c.tsv", "# none\n")), "scores")


def test_champion_join(spark, tmp_path):
    traffic = tsv.read_traffic(spark, write(tmp_path / "t.tsv", "a\tq\tt\tx\nb\tq\tt\ty\n"))
    scores = tsv.read_champion(spark, write(tmp_path / "s.tsv", "a\t0.5\nb\t1\n"))
    assert {r.id: r.score for r in tsv.with_champion(traffic, scores).collect()} == {"a": 0.5, "b": 1.0}
    with pytest.raises(Exception, match="no champion score"):
        tsv.with_champion(traffic, scores.where("id = 'a'")).collect()


def test_sinks_and_captures(spark, tmp_path):
    df = spark.createDataFrame([("a\n b", 0.5)], "x string, y double")
    tsv.write_tsv(df, str(tmp_path / "out"), ("x", "y"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a b\t0.5"]
    captures.write_json_lines(df.selectExpr("y AS b", "x AS a"), str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).first().value) == {"a": "a\n b", "b": 0.5}
    capture = {"scores": [{"id": "1", "intent_id": "w", "score": 0.5}, {"id": "2", "intent_id": "v", "score": 0.1}]}
    path = write(tmp_path / "c.json", json.dumps(capture, indent=1))
    assert [r.id for r in captures.read_capture(spark, path, "w").collect()] == ["1"]
    sweep = write(tmp_path / "s.csv", "k,centre,margin,agreement,self_match,ordering,total,ties\n4,0.3,0.1,0.2,0.9,3,4,0\n")
    assert captures.read_sweep(spark, sweep).first().ordering == 3
    with pytest.raises(ValueError, match="missing"):
        captures.read_sweep(spark, write(tmp_path / "bad.csv", "k,centre\n1,2\n"))
    assert captures.read_whole_text(spark, path).first().is_json


def test_first_champion_line_wins(spark, tmp_path):
    traffic = tsv.read_traffic(spark, write(tmp_path / "t.tsv", "a\tq\tt\tx\n"))
    scores = tsv.read_champion(spark, write(tmp_path / "s.tsv", "a\t0.25\na\t0.75\na\t0.5\n"))
    assert tsv.with_champion(traffic, scores).first().score == 0.25


def test_json_series_with_retries_and_column_list(spark, tmp_path):
    import io

    from quillon.sources import series

    block = {"hourly": {"time": ["2026-08-26T00:00", "2026-08-26T01:00"], "wind": [1, None], "rain": [0.5]}}
    calls = []

    def flaky(address, timeout):
        calls.append(address)
        if len(calls) == 1:
            raise OSError("no route")
        return io.StringIO(json.dumps(block))

    assert series.fetch_json("x", pause=0, open_=flaky) == block and len(calls) == 2
    with pytest.raises(OSError):
        series.fetch_json("x", pause=0, open_=lambda *a, **k: (_ for _ in ()).throw(OSError("down")))
    assert series.series_address("http://h/f", ["a", "b"], latitude="1") == "http://h/f?latitude=1&hourly=a%2Cb"
    path = write(tmp_path / "oslo.json", json.dumps(block))
    series.register(spark)
    reader = series.JsonSeriesReader(spark.createDataFrame([], "place string, pos int, time string, wind double, rain double").schema, {"base": f"file://{path}", "places": json.dumps({"Oslo": {}})})
    (part,) = reader.partitions()
    assert part.address.endswith("?hourly=wind%2Crain")
    part.address = f"file://{path}"
    assert list(reader.read(part)) == [("Oslo", 0, "2026-08-26T00:00", 1.0, 0.5), ("Oslo", 1, "2026-08-26T01:00", None, None)]


def test_places_manifest_and_cache(spark, tmp_path):
    import hashlib

    from quillon.sources import cache, series

    places = spark.createDataFrame([("Oslo", 2, 9.0), ("oslo ", 1, 59.9)], "name string, rank int, latitude double")
    got = {r.q: r.location for r in series.located(spark.createDataFrame([("OSLO",), ("Atlantis",), (None,)], "q string"), places).collect()}
    assert got["OSLO"].latitude == 59.9 and got["Atlantis"] is None and got[None] is None
    (tmp_path / "m").mkdir()
    write(tmp_path / "m" / "a.bin", "abc")
    (row,) = series.manifest(spark, str(tmp_path / "m")).collect()
    assert (row.length, row.sha256) == (3, hashlib.sha256(b"abc").hexdigest())
    fixtures = spark.createDataFrame([("1", 0.9, 0.8, 0.1)], "id string, self_match double, good double, bad double")
    traffic = spark.createDataFrame([("a", 1 / 3), ("b", 0.5)], "id string, score double")
    cache.write_raw_cache(fixtures, traffic, str(tmp_path / "c"))
    f, t = cache.read_raw_cache(spark, str(tmp_path / "c"))
    assert [tuple(r) for r in f.collect()] == [("1", 0.9, 0.8, 0.1)] and sorted(tuple(r) for r in t.collect()) == [("a", 1 / 3), ("b", 0.5)]
    fixtures.write.mode("append").parquet(str(tmp_path / "c" / "rows" / "kind=F"))
    with pytest.raises(ValueError, match="not what its header says"):
        cache.read_raw_cache(spark, str(tmp_path / "c"))


def test_stream_of_lines_is_scored(spark, tmp_path):
    from quillon.functions import scoring
    from quillon.streaming import scores

    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.tsv", "# corpus\na\twhat rain\tRain in Oslo today\tRain in Oslo\nb\\tq\\tt\\tx\n")
    scores.write_scores(scores.scored_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = dict(line.value.split("\t") for line in spark.read.text(str(tmp_path / "out")).collect())
    assert got == {"a": f"{scoring.score(b'what rain', b'Rain in Oslo today', b'Rain in Oslo')[1]:.6f}", "b": f"{scoring.score(b'q', b't', b'x')[1]:.6f}"}


def test_filters_and_scraped_records(spark):
    from quillon.operators import etl

    df = spark.createDataFrame([("w-1", 1), ("x-2", 2), (None, 3)], "id string, n int")
    assert [r.id for r in etl.with_prefix_if_any(df, "id", "w-").collect()] == ["w-1"] and etl.with_prefix_if_any(df, "id", "z-").count() == 3
    assert etl.without_suffix(df.withColumn("n_tmp", df.n), "_tmp").columns == ["id", "n"]
    place = spark.createDataFrame([("Oslo", 59.91234, -10.7)], "name string, lat double, lon double")
    assert tuple(etl.ledger_row(place, "name", "lat", "lon").first()) == ("Oslo", 599123, -107000)
    text = "intro 5\n\nEval margin: 0.75, agreement = -.5 after 3 runs\r\nrejected\n"
    rows = spark.createDataFrame([(text,)], "t string").select(etl.scraped_records(etl.F.col("t")).alias("r")).first().r
    assert [(r.line, r.margin, r.agreement, r.numbers) for r in rows] == [(2, 0.75, -0.5, [0.75, 5.0, 3.0]), (3, None, None, [])]
