"""Event streams: windowed counts with a watermark, sessions, the latest row of a key, and landing in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gondola.sources import snapshots


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of each kind by tumbling or, with slide, sliding windows; an event counts once."""
    return (
        events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no more than gap apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def land(events: DataFrame, path: str, by: str, state: str) -> StreamingQuery:
    """Every batch is added, once, to the table at path (a snapshot, partitioned by `by`).

    The table notes the state and number of the last batch with the rows themselves, in one step, so a batch that is
    run again after a failure is known.  Another state begins the source anew: its first batch
    takes the place of all that was landed.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = snapshots.manifest(batch.sparkSession, path)
        landed = held.marks.get("landed") if held else None
        same = landed is not None and landed["state"] == state
        if not same or number > landed["batch"]:
            snapshots.commit(batch, path, lambda f, _: same or landed is None, by=by, tag=str(number), marks={"landed": {"state": state, "batch": number}})

    return events.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def landed(spark: SparkSession, path: str) -> DataFrame:
    """What land() has written so far."""
    return snapshots.read(spark, path)
