"""The folder that all executors and the driver share, and what is stored below it.

It is named by ``spark.checkpoint.dir``; only where that is unset and the master is
local (tests, one machine) a temporary folder stands in.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.sources import snapshots


class NoSharedFolder(ValueError):
    """``spark.checkpoint.dir`` is unset on a cluster: executors would write to folders that others cannot read."""


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one on a local master and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise NoSharedFolder(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="gondola-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found else f"file://{found}"


#: (state of the inputs, version) of each mart when this application last looked, by application, input folder and name.
_seen: dict[tuple[str, str, str], tuple[dict, int]] = {}


def listing(spark: SparkSession, folder: str) -> dict[str, str]:
    """Size and time of every file below a folder, by path; one call a folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, str] = {}
    if fs.exists(at):
        for path, is_folder, size, time in _STATUS.findall(jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(at))):
            if is_folder == "true":
                found |= listing(spark, path)
            elif not path.rsplit("/", 1)[-1].startswith((".", "_")):
                found[_bare(path)] = f"{size}@{time}"
    return found


_STATUS = re.compile(r"path=(.*?); isDirectory=(true|false);(?: length=(\d+);)?.*?modification_time=(\d+)")


def _bare(file: str) -> str:
    """One name for a file, however plans, rows and listings write it."""
    return unquote(re.sub(r"^file:/+", "file:/", file))


def _plan(df: DataFrame) -> str:
    """Digest of a plan and of the settings that its results depend on, without the numbers that every session gives anew."""
    spark, most = df.sparkSession, "spark.sql.debug.maxToStringFields"
    was = spark.conf.get(most, "25")
    spark.conf.set(most, "1000000")  # nothing is left out of the text
    try:
        text = df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set(most, was)
    return hashlib.sha256((_settings(spark) + re.sub(r"#\d+L?|(?<=[a-z]_)\d+\b|@[0-9a-f]+", "", text)).encode()).hexdigest()


def _settings(spark: SparkSession) -> str:
    return " ".join(str(spark.conf.get(k)) for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"))


def mart_path(spark: SparkSession, sf: str, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/gondola/marts/{hashlib.sha256(sf.encode()).hexdigest()[:16]}/{name}"


def _changed(spark: SparkSession, sf: str, old: dict, new: dict, grows: str, places: dict) -> list | None:
    """Values of `grows` whose rows the difference of two states can touch; None: perhaps all.

    Of a raw table in `places` those in its changed files, now and when they were last read; of other marts those that their
    versions in between say.
    """
    values: set = set()
    tables = {_table_of(sf, f) for f in {**old["files"], **new["files"]} if old["files"].get(f) != new["files"].get(f)}
    for table in tables:
        if table not in places:
            return None
        files = [f for f in new["files"] if _table_of(sf, f) == table and old["files"].get(f) != new["files"][f]]
        gone = [f for f in old["files"] if _table_of(sf, f) == table and old["files"][f] != new["files"].get(f)]
        values |= {v for f in gone for v in old["values"][f]} | {v for f in files for v in new["values"][f]}
    if old["marts"].keys() != new["marts"].keys():
        return None
    for name, version in new["marts"].items():
        for v in range(old["marts"][name] + 1, version + 1):
            step = snapshots.manifest(spark, mart_path(spark, sf, name), v)
            if step is None or step.marks["changed"] is None:
                return None
            values |= set(step.marks["changed"])
    return sorted(values, key=lambda v: (v is None, v))


def _table_of(sf: str, file: str) -> str:
    return file.split(sf.rstrip("/") + "/", 1)[-1].split("/")[0].removesuffix(".parquet")


def _values_of(spark: SparkSession, sf: str, files: dict[str, str], old: dict, places: dict[str, str]) -> dict[str, list]:
    """The values of each file of a table in `places`; only files that are new or changed are read, and of these one column."""
    known = {f: v for f, v in old.get("values", {}).items() if old["files"].get(f) == files.get(f)}
    for table, value in places.items():
        fresh = [f for f in files if _table_of(sf, f) == table and f not in known]
        if fresh:
            rows = spark.read.parquet(*fresh).select(F.col("_metadata.file_path").alias("f"), F.expr(value).cast("string").alias("v")).distinct()
            found = rows.groupBy("f").agg(F.array_sort(F.collect_list("v")).alias("v"), F.max(F.col("v").isNull()).alias("z")).collect()
            by_name = {_bare(r["f"]): r["v"] + [None] * r["z"] for r in found}
            known |= {f: by_name.get(f, []) for f in fresh}  # a file without rows has none
    return known


def mart(*order: str, grows: str | None = None, places: dict[str, str] | None = None, below: Callable | None = None):
    """A plan whose result is stored below the shared folder, for this and later applications.

    It is kept with the digest of its plan and the files that it read (name, size, time); each call compares the listing of the input
    folder, so a session that lives long does not serve old rows.  Where inputs have changed the mart is built anew and swapped in one step.

    grows: a column of which each value's rows depend on the same value of the inputs alone.  Then only values that changed files
    hold are built (`places`: SQL of that value in a raw table) or that the marts below have changed, and only the mart's files
    with such rows are rewritten.  A build with a third parameter gets these values, to read no more than it needs.

    below: the one mart that the build reads, where building the plan is itself work; then that is not done before that mart has changed.

    Rows are dealt by the first column of `order` (large parts are split and small ones joined
    at run time, without a pass that samples) and sorted by all of them, so that statistics of files and
    row groups let a reader skip what a filter on these columns excludes, however
    deep the cascade is that made the filtered column.  forget() drops what is stored of a folder.
    """
    def wrap(build: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        name = build.__name__
        narrows = len(inspect.signature(build).parameters) > 2

        def update(spark: SparkSession, sf: str, path: str, listed: dict[str, str]) -> int:
            now: dict = {"plan": "", "files": {}, "marts": {}}
            version_of = lambda other: _seen[spark.sparkContext.applicationId, sf, other][1]
            if below:
                below(spark, sf)
                rows, now["plan"], now["marts"] = None, hashlib.sha256((_settings(spark) + inspect.getsource(build)).encode()).hexdigest(), {below.__name__: version_of(below.__name__)}
            else:
                rows = build(spark, sf)
                now["plan"] = _plan(rows)
                for f in rows.inputFiles():
                    if "/gondola/marts/" in f:
                        other = f.split("/data/")[0].rsplit("/", 1)[-1]
                        now["marts"][other] = version_of(other)
                    else:
                        now["files"][_bare(f)] = listed.get(_bare(f), "")
            held = snapshots.manifest(spark, path)
            old = held.marks if held else {}
            if old and all(old[k] == now[k] for k in now):
                return held.version
            rows = build(spark, sf) if rows is None else rows
            now["values"] = _values_of(spark, sf, now["files"], old, places or {})
            values = _changed(spark, sf, old, now, grows, places or {}) if grows and old and old["plan"] == now["plan"] else None
            if values is None:
                if order:
                    rows = rows.hint("rebalance", order[0]).sortWithinPartitions(*order)
                return snapshots.replace(rows, path, marks={**now, "changed": None}).version
            some = [F.lit(v).cast(rows.schema[grows].dataType) for v in values if v is not None]
            doomed = (F.col(grows).isin(some) if some else F.lit(False)) | (F.col(grows).isNull() if None in values else F.lit(False))
            fresh = (build(spark, sf, values) if narrows else rows).where(doomed)
            return snapshots.replace_where(fresh, path, doomed, sort=order, marks={**now, "changed": values}).version

        def read(spark: SparkSession, sf: str) -> DataFrame:
            key, path = (spark.sparkContext.applicationId, sf, name), mart_path(spark, sf, name)
            listed = listing(spark, sf)
            state = listed | {"settings": _settings(spark)}
            if key not in _seen or _seen[key][0] != state:
                try:
                    version = update(spark, sf, path, listed)
                except snapshots.Conflict:  # another application was first: what it built is looked at
                    version = update(spark, sf, path, listed)
                _seen[key] = (state, version)
            return snapshots.read(spark, path, _seen[key][1])

        read.__name__, read.__doc__ = name, build.__doc__
        return read

    return wrap


def tidy(spark: SparkSession, sf: str, keep: int = 2) -> int:
    """Drop all but the newest versions of the marts of an input folder; returns how many files went."""
    return sum(snapshots.vacuum(spark, mart_path(spark, sf, name), keep) for app, folder, name in list(_seen) if (app, folder) == (spark.sparkContext.applicationId, sf))


def forget(spark: SparkSession, sf: str) -> None:
    """Drop the stored marts of this input folder; they are built anew when they are next asked for."""
    for key in [k for k in _seen if k[:2] == (spark.sparkContext.applicationId, sf)]:
        snapshots.drop(spark, mart_path(spark, sf, key[2]))
        del _seen[key]


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, not yet made."""
    return f"{shared_root(spark).rstrip('/')}/gondola/{name}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once below the shared folder, and read from there: a lost executor cannot take it away."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
