"""Islands of equal labels, ranks of all rows, ranks with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.sources.workspace import stored


def islands(df: DataFrame, by: list[str], at: str, label: str, unknown: str = "Unknown") -> DataFrame:
    """Adds change (1 at the first row, at a new label and next to an unknown one), island and run_length."""
    w = Window.partitionBy(*by).orderBy(at)
    before = F.lag(label).over(w)
    change = F.when(before.isNull() | (before == unknown) | (F.col(label) == unknown) | (before != F.col(label)), 1).otherwise(0)
    out = df.withColumn("change", change).withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("run_length", F.row_number().over(Window.partitionBy(*by, "island").orderBy(at)).cast("long"))


def summed_before(df: DataFrame, order: list[Column], size: Column, name: str) -> DataFrame:
    """df with the sum of `size` over all rows before each in an order of all rows; the order must not leave ties.

    Rows are range-partitioned by the order and written down; each partition is
    summed on its own, and only their totals, one row a partition, meet in one task.
    """
    keys = [f"_o{k}" for k in range(len(order))]
    laid = stored(df.withColumns(dict(zip(keys, order))).withColumn("_size", size).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "numbered")
    unbounded = Window.unboundedPreceding
    before = Window.orderBy("_part").rowsBetween(unbounded, -1)
    starts = laid.groupBy("_part").agg(F.sum("_size").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(unbounded, -1)
    # one row for each partition of the range shuffle: a bound that data cannot exceed
    out = laid.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_first") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).cast("long"))
    return out.drop("_part", "_first", "_size", *keys)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place of each row (from 1) in an order of all rows; the order must not leave ties."""
    return summed_before(df, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def numbered_within(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with the place of each row (from 1) within its group, and `{name}_of`, the rows of the group.

    All rows are numbered by group and order, and a group's first place is taken off: a large group is many tasks' work.
    """
    placed = numbered(df, [*map(F.col, by), *order], "_place")
    same = [F.col(b).alias(f"_g{k}") for k, b in enumerate(by)]
    firsts = placed.groupBy(*same).agg(F.min("_place").alias("_low"), F.count("*").alias(f"{name}_of"))
    match = F.lit(True)
    for k, b in enumerate(by):
        match = match & F.col(b).eqNullSafe(F.col(f"_g{k}"))
    return placed.join(firsts, match).withColumn(name, F.col("_place") - F.col("_low") + 1).drop("_place", "_low", *[f"_g{k}" for k in range(len(by))])


def middle(value: Column, by: list[str]) -> Column:
    """The lower median of a group's values in the row at its place and null in the others, so the greatest of a group is its median.

    Exact: each group is sorted, on disk where it is large, and no state grows with its values.  Nulls are left out.
    """
    w = Window.partitionBy(*by).orderBy(value.asc_nulls_last())
    known = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(F.row_number().over(w) == F.ceil(known / 2), value)


def once(value: Column, by: list[str]) -> Column:
    """True in one row of each known value of a group, so that their number is its count of distinct values.

    Beside other aggregates count_distinct() keeps a state of all of them for each value; here rows are sorted, on disk where they are many.
    """
    return value.isNotNull() & (F.row_number().over(Window.partitionBy(*by, value).orderBy(value)) == 1)


def tile(place: Column, of: Column, tiles: int) -> Column:
    """ntile() of a place among so many rows: the first tiles are the longer ones."""
    short, longer = F.floor(of / tiles), of % tiles
    cut = longer * (short + 1)
    return F.when(place <= cut, F.floor((place - 1) / (short + 1)) + 1).otherwise(F.floor((place - 1 - cut) / F.greatest(short, F.lit(1))) + longer + 1).cast("long")


def average_rank(df: DataFrame, column: str, name: str, descending: bool = True) -> DataFrame:
    """df with the rank of a column, ties sharing their mean rank; nulls have none.

    Values are counted first, and ranks are sums of the counts before them, over range partitions of the values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    order = -F.col("_v") if descending else F.col("_v")
    ranks = summed_before(counts, [order], F.col("_n"), "_before").select("_v", (F.col("_before") + (F.col("_n") + 1) / 2).cast("double").alias(name))
    return df.join(ranks, df[column] == ranks["_v"], "left").drop("_v")
