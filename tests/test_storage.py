"""Writers and the event stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gondola.sources import sinks
from gondola.streaming import events


def test_replace_partitions_twice_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("a", 1), ("b", 2)], "day string, n int")
    fresh = spark.createDataFrame([("b", 3), ("b", 4)], "day string, n int")
    sinks.replace_partitions(old, path, "day")
    for _ in range(2):
        sinks.replace_partitions(fresh, path, "day", least_rows=2)
    assert sorted(map(tuple, spark.read.parquet(path).select("day", "n").collect())) == [("a", 1), ("b", 3), ("b", 4)]
    assert sinks.partition_exists(spark, path, "day", "a") and not sinks.partition_exists(spark, path, "day", "c")


def test_row_floor_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([("a", 1)], "day string, n int"), path, "day")
    with pytest.raises(sinks.TooFewRows):
        sinks.replace_partitions(spark.createDataFrame([("a", 2)], "day string, n int"), path, "day", least_rows=2)
    assert [x.n for x in spark.read.parquet(path).collect()] == [1]


def test_replace_append_delete_insert(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    sinks.append(one, path)
    sinks.append(one, path)
    assert spark.read.parquet(path).count() == 4
    sinks.replace(one, path)
    found = sinks.delete_insert(spark.read.parquet(path), spark.createDataFrame([(2, True), (2, False)], "k int, extra boolean"), "k")
    assert sorted(map(str, map(tuple, found.collect()))) == ["(1, 'x', None)", "(2, None, False)", "(2, None, True)"]


def test_stream_counts_each_event_once(spark, tmp_path):
    source, at = str(tmp_path / "in"), lambda d, h: dt.datetime(2024, 1, d, h)
    schema = "event_id long, ts timestamp, event_type string, value double"
    rows = [(1, at(1, 1), "a", 1.0), (1, at(1, 1), "a", 1.0), (2, at(1, 5), "a", 2.0), (3, at(1, 6), "b", 4.0), (4, at(3, 1), "a", 8.0)]
    spark.createDataFrame(rows, schema).write.parquet(source)
    out = events.windowed(events.read(spark, source, schema))
    run = out.writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("counted").select(F.dayofmonth("window.start"), "event_type", "n", "total").collect()
    # the last day is still open: the watermark has not passed its end
    assert sorted(map(tuple, got)) == [(1, "a", 2, 3.0), (1, "b", 1, 4.0)]


def test_sliding_windows_and_sessions(spark, tmp_path):
    source, at = str(tmp_path / "in"), lambda d, h, m=0: dt.datetime(2024, 1, d, h, m)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = [(1, at(1, 1), 7, "a", 1.0), (2, at(1, 1, 20), 7, "a", 2.0), (3, at(1, 3), 7, "a", 4.0), (4, at(1, 1, 5), 8, "a", 8.0), (5, at(9, 1), 7, "a", 0.0)]
    spark.createDataFrame(rows, schema).write.parquet(source)

    def run(frame, name):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = run(events.sessions(events.read(spark, source, schema)), "sessions").select("user_id", "n").collect()
    assert sorted(map(tuple, got)) == [(7, 1), (7, 2), (8, 1)]
    got = run(events.windowed(events.read(spark, source, schema), "2 hours", "1 hour", "1 hour"), "sliding").select(F.hour("window.start"), "n").where("n > 0").collect()
    assert sorted(map(tuple, got)) == [(0, 3), (1, 3), (2, 1), (3, 1)]


def test_landing_a_batch_again_leaves_one_copy(spark, tmp_path):
    source, path, schema = str(tmp_path / "in"), str(tmp_path / "out"), "day string, n int"
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(source)
    for state in ("one", "two"):  # another state: the same files are read again
        events.land(events.read(spark, source, schema), path, "day", str(tmp_path / state)).awaitTermination(120)
    assert sorted((r["day"], r["n"]) for r in sinks.read(spark, path).collect()) == [("a", 1), ("b", 2)]
