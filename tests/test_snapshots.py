"""Tables that change in one step: each step as the last one, versions, conflicts, landing of streams; plain folders after a crash."""

import pytest
from pyspark.sql import functions as F

from gondola.sources import sinks, snapshots
from gondola.streaming import events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.append(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "day string, n int"), path, by="day")
    return path


CHANGES = {
    "append": (lambda df, path: snapshots.append(df, path, by="day"), [("a", 1), ("b", 2), ("b", 3), ("b", 9), ("c", 4)]),
    "replace": (lambda df, path: snapshots.replace(df, path, by="day"), [("b", 9), ("c", 4)]),
    "partitions": (lambda df, path: snapshots.replace_partitions(df, path, by="day"), [("a", 1), ("b", 9), ("c", 4)]),
    "keys": (lambda df, path: snapshots.replace_keys(df, path, ["day"], by="day"), [("a", 1), ("b", 9), ("c", 4)]),
    "where": (lambda df, path: snapshots.replace_where(df, path, F.col("n") == 2, by="day"), [("a", 1), ("b", 3), ("b", 9), ("c", 4)])}


@pytest.mark.parametrize("change", sorted(CHANGES))
def test_a_kill_between_any_two_steps(spark, table, monkeypatch, change):
    """Dead before or after each of the three steps: the old table, or after the last one the new one; then the change works."""
    fresh, (run, new) = spark.createDataFrame([("b", 9), ("c", 4)], "day string, n int"), CHANGES[change]
    old = rows(snapshots.read(spark, table))

    class Killed(BaseException):
        pass

    for step in ("_stage", "_note", "_publish"):
        for after in (False, True):
            with monkeypatch.context() as m:
                plain = getattr(snapshots, step)

                def dies(*a, plain=plain, after=after):
                    if after:
                        plain(*a)
                    raise Killed

                m.setattr(snapshots, step, dies)
                with pytest.raises(Killed):
                    run(fresh, table)
            if step == "_publish" and after:
                assert rows(snapshots.read(spark, table)) == sorted(new)
            else:
                assert rows(snapshots.read(spark, table)) == old
                snapshots.vacuum(spark, table)
                assert rows(snapshots.read(spark, table)) == old
    if change != "append":
        run(fresh, table)  # once more: the same
    assert rows(snapshots.read(spark, table)) == sorted(new) or change == "where"


def test_versions_and_vacuum(spark, table):
    old = snapshots.read(spark, table)
    snapshots.replace_partitions(spark.createDataFrame([("b", 7, "x")], "day string, n int, extra string"), table, by="day")
    assert rows(old) == [("a", 1), ("b", 2), ("b", 3)]  # a reader keeps what it began with
    assert sorted(map(str, rows(snapshots.read(spark, table)))) == ["('a', 1, None)", "('b', 7, 'x')"]
    assert rows(snapshots.read(spark, table, 1)) == [("a", 1), ("b", 2), ("b", 3)] and snapshots.versions(spark, table) == [1, 2]
    assert snapshots.vacuum(spark, table) > 0 and snapshots.versions(spark, table) == [2] and snapshots.vacuum(spark, table) == 0
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, table, 1)
    assert rows(snapshots.read(spark, table).select("day", "n")) == [("a", 1), ("b", 7)]


def test_refusals(spark, table, tmp_path):
    fresh = spark.createDataFrame([("c", 1)], "day string, n int")
    with pytest.raises(snapshots.TooFewRows):
        snapshots.append(fresh, table, by="day", least_rows=2)
    with pytest.raises(snapshots.SchemaConflict):
        snapshots.append(fresh.withColumn("n", F.lit("x")), table, by="day")
    base = snapshots.manifest(spark, table)
    snapshots.append(fresh, table, by="day")
    with pytest.raises(snapshots.Conflict):  # a writer that looked at the table before
        snapshots.append(fresh, table, by="day", base=base)
    assert rows(snapshots.read(spark, table)) == [("a", 1), ("b", 2), ("b", 3), ("c", 1)]
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, str(tmp_path / "none"))
    snapshots.replace(fresh.limit(0), table)
    assert rows(snapshots.read(spark, table)) == [] and snapshots.read(spark, table).columns == ["day", "n"]


def test_only_files_with_doomed_rows_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(4):
        snapshots.append(spark.range(10 * k, 10 * k + 10).coalesce(1), path)
    before = {f.path for f in snapshots.manifest(spark, path).files}
    snapshots.replace_where(spark.createDataFrame([(100,)], "id long"), path, F.col("id") == 15, sort=("id",))
    after = {f.path for f in snapshots.manifest(spark, path).files}
    assert len(before - after) == 1
    assert [r[0] for r in rows(snapshots.read(spark, path))] == [k for k in range(40) if k != 15] + [100]
    snapshots.replace_keys(spark.createDataFrame([(3,), (100,), (None,)], "id long"), path, ["id"])
    assert sorted(str(r[0]) for r in rows(snapshots.read(spark, path).where("id is not null"))) == sorted(str(k) for k in [*range(15), *range(16, 40), 100])


def test_landing_keeps_all_batches(spark, tmp_path):
    """Two batches with one day; a batch that is run again; a state that begins anew."""
    source, path, state, schema = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "day string, n int"
    run = lambda s: events.land(events.read(spark, source, schema), path, "day", s).awaitTermination(120)
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(source)
    run(state)
    spark.createDataFrame([("a", 5)], schema).write.mode("append").parquet(source)
    run(state)
    assert rows(events.landed(spark, path)) == [("a", 1), ("a", 5), ("b", 2)]
    (tmp_path / "state" / "commits" / "1").unlink()  # as if the driver had died before it noted the second batch
    (tmp_path / "state" / "commits" / ".1.crc").unlink()
    run(state)
    assert rows(events.landed(spark, path)) == [("a", 1), ("a", 5), ("b", 2)]
    run(str(tmp_path / "other"))
    assert rows(sinks.read(spark, path)) == [("a", 1), ("a", 5), ("b", 2)]


def test_plain_folders_after_a_crash(spark, tmp_path, monkeypatch):
    """A writer dies after the old data were moved aside: they come back; after the new ones came: those count."""
    one, two = (spark.createDataFrame([(1, x)], "k int, v string") for x in "xy")
    plain = sinks._files

    class Killed(BaseException):
        pass

    def dying(after):
        def files(spark, path):
            fs, place, at = plain(spark, path)

            class Fs:
                def __getattr__(self, name):
                    return getattr(fs, name)

                def rename(self, a, b):
                    out = fs.rename(a, b)
                    if after in b.toString():
                        raise Killed
                    return out

            return Fs(), place, at

        return files

    for writer, path in ((lambda df, p: sinks.replace_keys(df, p, "k"), str(tmp_path / "k")), (lambda df, p: sinks.replace_partitions(df, p, "k"), str(tmp_path / "p"))):
        writer(one, path)
        with monkeypatch.context() as m:
            m.setattr(sinks, "_files", dying(sinks.ASIDE))
            m.setattr(sinks, "settle", lambda *_: None)
            with pytest.raises(Killed):
                writer(two, path)
        assert [r["v"] for r in sinks.read(spark, path).collect()] == ["x"]
        writer(two, path)
        assert [r["v"] for r in sinks.read(spark, path).collect()] == ["y"] and [r["v"] for r in spark.read.parquet(path).collect()] == ["y"]
