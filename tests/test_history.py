"""Islands over a stream, batch by batch, against the window of all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gondola.operators.windows import islands
from gondola.streaming import events, history

SCHEMA = "store_id long, category string, at timestamp, label string"


def stream(spark, tmp_path, batches, **options):
    """What the stream gives for these batches, each a run of its own over the same state."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        q = history.run_lengths(events.read(spark, source, SCHEMA), **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    return spark.read.parquet(out)


@pytest.mark.parametrize("cuts", [[], [3, 7], [1, 2, 5, 6, 11]])
def test_any_split_into_batches(spark, tmp_path, cuts):
    rng = random.Random(len(cuts))
    month = lambda k: dt.datetime(2024 + k // 12, k % 12 + 1, 1)
    rows = [(s, c, month(k), rng.choice(["Overpriced", "Overpriced", "Underpriced", "Unknown"])) for s in range(4) for c in "ab" for k in range(14) if rng.random() < 0.9]
    edges = [0, *cuts, 14]
    batches = [[r for r in rows if month(a) <= r[2] < month(b) if b < 24] for a, b in zip(edges, edges[1:])]
    rng.shuffle(batches[0])
    got = stream(spark, tmp_path, batches, silent_days=10_000).where("kind = 'row'").select("store_id", "category", "at", "label", "change", "island", "run_length").collect()
    want = islands(spark.createDataFrame(rows, SCHEMA), history.KEYS, "at", "label").select("store_id", "category", "at", "label", "change", "island", "run_length").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_late_and_silent_pairs(spark, tmp_path):
    at = lambda m, d=1: dt.datetime(2026, m, d)
    batches = [[(1, "a", at(1), "Fair"), (2, "a", at(1), "Fair")], [(1, "a", at(2), "Fair"), (1, "a", at(6), "Fair")], [(1, "a", at(7), "Fair"), (1, "a", at(6), "Unknown")], [(1, "a", at(8), "Unknown")]]
    got = stream(spark, tmp_path, batches, silent_days=92, late="300 days").select("store_id", F.month("at").alias("m"), "kind", "run_length").collect()
    assert sorted((tuple(r) for r in got if r.kind != "silent"), key=str) == sorted([(1, 1, "row", 1), (2, 1, "row", 1), (1, 2, "row", 2), (1, 6, "row", 3), (1, 7, "row", 4), (1, 6, "late", None), (1, 8, "row", 1)], key=str)
    quiet = stream(spark, tmp_path / "two", [batches[0], batches[1], batches[3]], silent_days=92).where("kind = 'silent'").collect()
    assert [(r.store_id, r.run_length) for r in quiet] == [(2, 1)]
