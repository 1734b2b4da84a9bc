"""The data source of the collectors: failures as rows, retries, what is fresh, the gate."""

import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gondola.sources import collect, snapshots
from gondola.sources.records import Incomplete

DAY = date(2026, 8, 1)


def flaky(root):
    """A transport whose keys say what happens: `down` never answers, `slow` answers the third time, `none` is unknown; it counts what it is asked."""

    def get(source, key):
        at = Path(root, f"{source}-{key}".replace("/", "_"))
        n = len(at.read_text()) if at.exists() else 0
        at.write_text("x" * (n + 1))
        if key == "none":
            raise collect.Missing("no such key")
        if key.startswith("down") or (key == "slow" and n < 2):
            raise OSError("no answer")
        return json.dumps({"key": key})

    return get


def ask(spark, keys, tmp_path, **options):
    requests = spark.createDataFrame(keys, "source string, key string")
    return collect.collect(spark, requests, str(tmp_path), str(tmp_path / "table"), options.pop("as_of", DAY), transport="tests.test_collect:flaky", pause=0, **options)


def asked(tmp_path, name):
    at = tmp_path / name
    return len(at.read_text()) if at.exists() else 0


KEYS = [("s", "a"), ("s", "b"), ("s", "slow"), ("t", "c/d"), ("t", "e"), ("t", "f"), ("t", "g"), ("t", "none"), ("s", "down")]


def test_failures_are_rows(spark, tmp_path):
    got = {(r.source, r.key): r for r in ask(spark, [*KEYS, ("s", "a"), (None, "x"), ("s", None)], tmp_path, gate=collect.Gate(0.7)).collect()}
    assert len(got) == len(KEYS)
    assert (got["s", "slow"].status, got["s", "slow"].attempts) == ("ok", 3) and json.loads(got["s", "slow"].body) == {"key": "slow"}
    assert (got["s", "down"].status, got["s", "down"].attempts, got["s", "down"].body) == ("failed", 3, None) and "no answer" in got["s", "down"].error
    assert (got["t", "none"].status, got["t", "none"].attempts) == ("missing", 1)
    assert snapshots.read(spark, str(tmp_path / "table")).count() == len(KEYS) and collect.latest(spark, str(tmp_path / "table")).count() == 7
    assert asked(tmp_path, "s-a") == 1


def test_a_batch_below_the_gate_keeps_nothing(spark, tmp_path):
    with pytest.raises(Incomplete, match="7 of 9"):
        ask(spark, KEYS, tmp_path)
    assert snapshots.manifest(spark, str(tmp_path / "table")) is None
    with pytest.raises(Incomplete, match="answers of t"):
        ask(spark, KEYS, tmp_path, gate=collect.Gate(0.5, required=("t",)))
    with pytest.raises(Incomplete, match="answers of u"):
        ask(spark, [("s", "a")], tmp_path, gate=collect.Gate(0.5, required=("u",)))
    assert snapshots.manifest(spark, str(tmp_path / "table")) is None


def test_a_rerun_asks_for_what_failed(spark, tmp_path):
    gate, path = collect.Gate(0.7), str(tmp_path / "table")
    ask(spark, KEYS, tmp_path, gate=gate, requestsPerTask=4)
    again = ask(spark, KEYS, tmp_path, gate=gate, as_of=date(2026, 8, 3))
    assert sorted(r.key for r in again.collect()) == ["down", "none"] and asked(tmp_path, "s-a") == 1
    version = snapshots.manifest(spark, path).version
    good = [k for k in KEYS if k[1] not in ("down", "none")]
    assert ask(spark, good, tmp_path, as_of=date(2026, 8, 3)).count() == 0 and snapshots.manifest(spark, path).version == version
    later = ask(spark, good, tmp_path, as_of=date(2026, 8, 8))  # a week later all are due
    assert later.count() == 7 and asked(tmp_path, "s-a") == 2
    assert {r.asked_on for r in collect.latest(spark, path).collect()} == {date(2026, 8, 8)}
    assert ask(spark, [], tmp_path).count() == 0


def test_stored_answers(spark, tmp_path):
    """Names of folders as partitionBy writes them; bodies of several lines; a folder without the key."""
    keys = ["a b", "c/d:e?", "50%", "é=ü", "x'\"y"]
    made = spark.createDataFrame([("s", k, f"first {k}\nsecond") for k in keys], "source string, key string, body string")
    made.write.partitionBy("source", "key").text(str(tmp_path / "root"))
    requests = made.select("source", "key").unionAll(spark.createDataFrame([("s", "lost")], "source string, key string"))
    got = {r.key: (r.body, r.status) for r in collect.answers(spark, requests, f"file://{tmp_path}/root").collect()}
    assert got == {k: (f"first {k}\nsecond", "ok") for k in keys} | {"lost": (None, "missing")}
    assert spark.read.format("answers").option("requests", "x").option("path", "y") is not None
    empty = collect.answers(spark, requests.limit(0), f"file://{tmp_path}/root")
    assert empty.count() == 0 and empty.columns == [x.split()[0] for x in collect.ANSWER.split(", ")] and F is not None
