"""Writers and probes: full replace, append, idempotent partition replace with a row floor, delete-insert by key.

These write plain Parquet folders, which any reader opens by path; tables that change in one step are in `snapshots`.

A partition replace is written to a folder that readers skip, counted there, and then
moved into place partition by partition: the input is evaluated once, and nothing
changes where there are too few rows or a column has another type than before.  What is replaced is moved aside before and
deleted last, so a writer that dies loses nothing: read() and the next writer put back what has nothing in its place.
Columns may be added; readers see them with mergeSchema.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.sources import snapshots
from gondola.sources.snapshots import SchemaConflict, TooFewRows  # noqa: F401


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    files, place, _ = _files(spark, path)
    return files.exists(place)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


ASIDE = "_aside"


def settle(spark: SparkSession, path: str) -> None:
    """Finish what a writer left: old data aside go back where nothing took their place, else they go."""
    files, place, at = _files(spark, path)
    old = at(f"{path}.{ASIDE}")
    if files.exists(old):
        if not files.exists(place):
            files.rename(old, place)
        else:
            files.delete(old, True)
    aside = at(f"{path}/{ASIDE}")
    if files.exists(aside):
        for s in files.listStatus(aside):
            target = at(f"{path}/{s.getPath().getName()}")
            if not files.exists(target):
                files.rename(s.getPath(), target)
        files.delete(aside, True)


def _swap(spark: SparkSession, fresh: str, target: str, aside: str) -> None:
    """A folder in another's place, which is moved aside; settle() undoes half a swap."""
    files, new, at = _files(spark, fresh)
    if files.exists(at(target)):
        files.mkdirs(at(aside).getParent())
        files.rename(at(target), at(aside))
    files.rename(new, at(target))
    files.delete(at(aside), True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table whose partitions may differ in added columns."""
    if exists(spark, f"{path}/manifests"):
        return snapshots.read(spark, path)
    settle(spark, path)
    return spark.read.option("mergeSchema", "true").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str, least_rows: int = 0) -> None:
    """Replace only the partitions that df has; running it twice leaves one copy."""
    spark, staged = df.sparkSession, f"{path}/_staged-{uuid.uuid4().hex}"
    files, place, at = _files(spark, path)
    settle(spark, path)
    if files.exists(place) and any(not s.getPath().getName().startswith(("_", ".")) for s in files.listStatus(place)):
        held = dict(read(spark, path).dtypes)
        odd = [c for c, kind in df.dtypes if c != by and held.get(c, kind) != kind]
        if odd:
            raise SchemaConflict(f"other types than stored: {', '.join(odd)}")
    df.write.partitionBy(by).parquet(staged)
    try:
        if least_rows and spark.read.parquet(staged).count() < least_rows:
            raise TooFewRows(f"fewer than {least_rows} rows")
        for s in files.listStatus(at(staged)):
            name = s.getPath().getName()
            if name.startswith(f"{by}="):
                _swap(spark, s.getPath().toString(), f"{path}/{name}", f"{path}/{ASIDE}/{name}")
    finally:
        settle(spark, path)
        files.delete(at(staged), True)


def partition_exists(spark: SparkSession, path: str, by: str, value: str) -> bool:
    return exists(spark, path) and not read(spark, path).where(F.col(by) == value).limit(1).isEmpty()


def recent_keys(df: DataFrame, at: str, keys: list[str], as_of: Column, days: int = 6) -> DataFrame:
    """Keys collected in the last days before as_of, which need no other collection."""
    return df.where(F.col(at) >= F.date_sub(as_of, days)).select(*keys).distinct()


def delete_insert(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """existing without the keys of fresh, and fresh."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def replace_keys(fresh: DataFrame, path: str, key: str) -> None:
    """Write delete_insert() in place of what is stored: a new folder first, which then takes the old one's name."""
    spark = fresh.sparkSession
    settle(spark, path)
    if not exists(spark, path):
        replace(fresh, path)
        return
    staged = f"{path}.{uuid.uuid4().hex}"
    delete_insert(read(spark, path), fresh, key).write.parquet(staged)
    _swap(spark, staged, path, f"{path}.{ASIDE}")


def export(df: DataFrame, most: int = 1_000_000):
    """df for a local reader as pandas; refuses more than `most` rows rather than cut them."""
    found = df.limit(most + 1).toPandas()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: write them instead")
    return found


def manifest_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(document_id, filename, text, status) for each manifest row: the whole file as text, or status PENDING where there is none."""
    found = spark.createDataFrame([], "filename string, text string")
    if exists(spark, folder):
        whole = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))
        found = whole.select(F.url_decode("filename").alias("filename"), "text")
    return manifest.join(found, "filename", "left").select(
        "document_id", "filename", "text", F.when(F.col("text").isNull(), "PENDING").otherwise("OK").alias("status"))


def due_status(days: Column, warn_days: int, error_days: int) -> Column:
    return F.when(days.isNull() | (days > error_days), "error").when(days > warn_days, "warn").otherwise("pass")


def due(df: DataFrame, at: str, as_of: date, warn_days: int, error_days: int) -> DataFrame:
    """(last, days, status) of one source: pass, warn or error by its age; error without rows."""
    days = F.date_diff(F.lit(as_of), F.to_date("last"))
    return df.agg(F.max(at).alias("last")).select("last", days.alias("days"), due_status(days, warn_days, error_days).alias("status"))
