from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillon.streaming import windows

SCHEMA = "ts timestamp, user_id long, value double, code int"
T0 = datetime(2024, 1, 1)


def feed(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def run(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_rolling_summary_equals_batch(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=37 * i), i % 3, float(i), [0, 3, 61, 95][i % 4]) for i in range(60)]
    stream = feed(spark, tmp_path, [rows])
    got = run(windows.rolling_summary(stream, "ts", "user_id", "value", "code"), "rolling", "complete", tmp_path)
    batch = spark.createDataFrame(rows, SCHEMA).groupBy(F.window("ts", "24 hours", "1 hour"), "user_id").agg(F.count("*").alias("n"), F.max("value").alias("high")).collect()
    assert sorted((r.window.start, r.user_id, r.n, r.high) for r in got) == sorted((r.window.start, r.user_id, r.n, r.high) for r in batch)


def test_repeats_and_last_known(spark, tmp_path):
    first = [(T0, 1, 5.0, 0), (T0 + timedelta(seconds=1), 1, 6.0, 0), (T0, 2, None, 0)]
    second = [(T0 + timedelta(seconds=5), 1, None, 0)]
    stream = feed(spark, tmp_path, [first, second])
    assert len(run(windows.without_repeats(stream, "ts", ["user_id"]), "repeats", "append", tmp_path)) == 2
    known = run(windows.last_known(stream, "ts", "user_id", "value"), "known", "update", tmp_path)
    ones = [(r.known, r.stale) for r in known if r.key == 1]
    assert (6.0, False) in ones or (6.0, True) in ones
    assert all(r.known is None for r in known if r.key == 2)
