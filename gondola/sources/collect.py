"""Collecting answers of remote sources: a Python data source, and a collection with retries, a freshness cache and a gate.

`answers` is a format for spark.read.  Each request (source, key) is a partition of its own, asked for by an executor
through a transport; a request that fails is a row with its error, not a failed job.  What fails for the moment is
tried again after a pause that doubles.  The transport that is built in reads stored answers; another one is given as `module:function`.

collect() asks for what was not answered lately, looks at all rows before any is kept, and adds them to a snapshot table in one step.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gondola.sources import snapshots
from gondola.sources.records import Incomplete
from gondola.sources.workspace import scratch, stored

ANSWER = "source string, key string, body string, status string, error string, attempts int"


class Missing(LookupError):
    """The source has no such answer; asking again does not help."""


Transport = Callable[[str, str], str]


#: Characters that names of partition folders write as %XX, beside control characters.
ESCAPED = set("\"#%'*/:=?\\{[]^\x7f")


def folder_name(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or c < " " else c for c in value)


def folder(root: str) -> Transport:
    """Stored answers: text files below root/source=<source>/key=<key>, as partitionBy writes them."""
    system, top = fs.FileSystem.from_uri(root)

    def get(source: str, key: str) -> str:
        place = f"{top}/source={folder_name(source)}/key={folder_name(key)}"
        found = system.get_file_info(fs.FileSelector(place, allow_not_found=True))
        names = sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))
        if not names:
            raise Missing(f"no answer for {key}")
        parts = []
        for name in names:
            with system.open_input_stream(name) as stream:
                parts.append(stream.read().decode())
        return "".join(parts).rstrip("\n")

    return get


@dataclass
class Ask(InputPartition):
    """Requests that one task makes."""

    requests: list[tuple[str, str]]


class AnswerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.requests, self.root = options["requests"], options["path"]
        self.transport = options.get("transport", f"{__name__}:folder")
        self.tries, self.pause, self.each = int(options.get("tries", 3)), float(options.get("pause", 0.5)), int(options.get("requestsPerTask", 1))

    def partitions(self) -> list[Ask]:
        """The plan: as a listing of files, the requests' names pass through the driver, their answers do not."""
        system, path = fs.FileSystem.from_uri(self.requests)
        held = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["source", "key"])
        pairs = sorted(zip(held["source"].to_pylist(), held["key"].to_pylist()))
        return [Ask(pairs[k : k + self.each]) for k in range(0, len(pairs), self.each)] or [Ask([])]

    def read(self, partition: Ask) -> Iterator[pa.RecordBatch]:
        module, name = self.transport.split(":")
        get = getattr(importlib.import_module(module), name)(self.root)
        for source, key in partition.requests:
            row = (source, key, *asked(get, source, key, self.tries, self.pause))
            kinds = (pa.string(),) * 5 + (pa.int32(),)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [x.split()[0] for x in ANSWER.split(", ")])


def asked(get: Transport, source: str, key: str, tries: int, pause: float) -> tuple[str | None, str, str | None, int]:
    """(body, status, error, attempts) of one request."""
    error, n = None, 0
    for n in range(1, tries + 1):
        try:
            return get(source, key), "ok", None, n
        except Missing as e:
            return None, "missing", str(e), n
        except Exception as e:  # of one request: it becomes a row, the others go on
            error = f"{type(e).__name__}: {e}"
            if n < tries:
                time.sleep(pause * 2 ** (n - 1))
    return None, "failed", error, n


class Answers(DataSource):
    """spark.read.format("answers"): options requests (Parquet of source, key), path, transport, tries, pause, requestsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema) -> AnswerReader:
        return AnswerReader(dict(self.options))


def answers(spark: SparkSession, requests: DataFrame, root: str, **options: object) -> DataFrame:
    """(ANSWER) of each distinct request (source, key)."""
    spark.dataSource.register(Answers)
    plan = scratch(spark, "requests")
    requests.select("source", "key").where("source is not null and key is not null").distinct().write.parquet(plan)
    reader = spark.read.format("answers").option("requests", plan).option("path", root)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


@dataclass(frozen=True)
class Gate:
    least_share: float = 0.8  #: of all requests, answered now or lately
    required: tuple[str, ...] = ()  #: sources that must have all their answers


def recent(spark: SparkSession, path: str, as_of: date, days: int) -> DataFrame:
    """(source, key) that were answered in the last days before as_of."""
    if snapshots.manifest(spark, path) is None:
        return spark.createDataFrame([], "source string, key string")
    held = snapshots.read(spark, path)
    fresh = (F.col("asked_on") > F.date_sub(F.lit(as_of), days)) & (F.col("asked_on") <= F.lit(as_of))
    return held.where(fresh & (F.col("status") == "ok")).select("source", "key").distinct()


def collect(spark: SparkSession, requests: DataFrame, root: str, path: str, as_of: date, days: int = 7, gate: Gate = Gate(), **options: object) -> DataFrame:
    """Ask for what was not answered in the last days; returns this collection's rows, which are then in the table at path.

    With fewer answers than the gate wants an Incomplete is raised and the table stays as it was.  A rerun asks for what
    failed, and where nothing is left to ask changes nothing.
    """
    wanted = requests.select("source", "key").where("source is not null and key is not null").distinct()
    late = recent(spark, path, as_of, days)
    due = wanted.join(late, ["source", "key"], "left_anti")
    found = stored(answers(spark, due, root, **options).withColumn("asked_on", F.lit(as_of)), "answers")
    counts = {r["source"]: r for r in wanted.join(found, ["source", "key"], "left").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if((F.col("status") == "ok") | F.col("status").isNull()).alias("ok")).collect()}  # one row a source; without a status: answered lately
    n, ok = (sum(r[k] for r in counts.values()) for k in ("n", "ok"))
    if ok < gate.least_share * n:
        raise Incomplete(f"{ok} of {n} requests answered")
    for source in gate.required:
        if source not in counts or counts[source]["ok"] < counts[source]["n"]:
            raise Incomplete(f"answers of {source} are missing")
    if not found.isEmpty():
        snapshots.append(found, path, by="source", tag=str(as_of))
    return found


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest answer to each request."""
    held = snapshots.read(spark, path).where("status = 'ok'")
    return held.groupBy("source", "key").agg(F.max_by("body", "asked_on").alias("body"), F.max("asked_on").alias("asked_on"))
