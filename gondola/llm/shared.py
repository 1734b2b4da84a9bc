"""What the training-data operators share: shared storage, prefix sums, components.

Intermediate tables live below the folder named by ``spark.checkpoint.dir``,
which every executor and the driver can reach; only where that is unset and the
master is local (tests, one machine) a temporary folder stands in.  A written table cuts lineage and
survives lost executors, which cached blocks would not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gondola.sources.workspace import NoSharedFolder, shared_root  # noqa: F401

#: Bytes and rows of one Arrow batch that crosses into Python.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096


@contextmanager
def shuffle_tasks(spark: SparkSession, tasks: int) -> Iterator[None]:
    """At least so many shuffle partitions for the jobs that run inside; small ones are joined again at run time."""
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, str(max(int(was), int(tasks))))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/gondola/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder, and read from there."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.gondola_path = path
    return kept


def bounded_batches(spark: SparkSession) -> None:
    """Limit what one Arrow batch may hold, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def global_prefix(df: DataFrame, order: list[Column], size: str, name: str) -> DataFrame:
    """df with ``before`` (sum of `size` over all rows before it) and ``rank`` (their number).

    Rows are range-partitioned by `order` (a row number breaks ties, so that equal
    keys can be split over partitions), each partition is summed on its own, and
    only the totals, one row a partition, meet in one place.  The arrangement is
    written down first: a lost task cannot come back with another one.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    tagged = df.withColumns(dict(zip(keys, order))).withColumn("_row", F.monotonically_increasing_id())
    laid = stored(tagged.repartitionByRange(*keys, "_row").withColumn("_part", F.spark_partition_id()), name)
    totals = laid.groupBy("_part").agg(F.sum(size).alias("_sum"), F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
    )
    inside = Window.partitionBy("_part").orderBy(*keys, "_row")
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = laid.withColumns({
        "before": F.coalesce(F.sum(size).over(run), F.lit(0)),
        "rank": (F.row_number().over(inside) - 1).cast("long"),
    })
    # one row for each partition of the range shuffle: a bound that data cannot exceed
    return (
        out.join(F.broadcast(starts), "_part")
        .withColumns({"before": (F.col("before") + F.col("_sum0")).cast("long"), "rank": F.col("rank") + F.col("_n0")})
        .drop("_part", "_row", "_sum0", "_n0", *keys)
    )


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b): root is the smallest reachable.

    Alternating large-star and small-star rounds: each round hangs the neighbours
    of a node under the smallest of them.  Minima are combined before the
    shuffle, and joins split hot hubs.  Each round is written down, the last but
    one deleted; nothing goes to the driver but two counts.
    """
    spark = links.sparkSession
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        done = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        drop_path(spark, edges.gondola_path)
        edges = done
        parents = edges.groupBy("a").agg(F.count("*").alias("n"))
        open_ends = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a").distinct(), "a", "left_semi")
        if parents.where("n > 1").unionByName(open_ends.select("a", F.lit(2).alias("n"))).isEmpty():
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
