"""As-of joins and exact vector search."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, left_at: str, right_at: str, by: list[str], values: list[str]) -> DataFrame:
    """left with the latest right row whose time is not after left's; nulls where there is none; of right rows with one time that with the greatest values.  Without a time a row meets nothing; null keys are one key.

    One union and one window that carries the last right row forward: no range
    join, so cost is a sort of both sides whatever their sizes.  The time axis of each key, or of all rows without keys,
    is cut into years, each sorted on its own, and the last right row of each year is carried on in a
    table of one row a key and year.  Adds right_at.
    """
    carried = [right_at, *values]
    l = left.withColumns({"_at": F.col(left_at), "_side": F.lit(1)}).withColumn("_r", F.lit(None).cast(right.select(F.struct(*carried)).schema[0].dataType))
    r = right.where(F.col(right_at).isNotNull()).select(*by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*carried).alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_slice", F.year("_at"))
    w = Window.partitionBy(*by, "_slice").orderBy("_at", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    ends = both.groupBy(*by, "_slice").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_at", "_r"))).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    same = {b: f"_b{k}" for k, b in enumerate(by)} | {"_slice": "_year"}
    ends = ends.select(*[F.col(b).alias(n) for b, n in same.items()], F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    match = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(n)) for b, n in same.items()])
    # without keys one row a year, else joined by its size at run time
    out = out.join(ends if by else F.broadcast(ends), match).withColumn("_r", F.coalesce("_r", "_before"))
    return out.select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in carried])


def distance_to(query: list[float]):
    """UDF: cosine distance of vectors to one vector, in double; null for null, empty and zero vectors and other lengths.

    Marked as not deterministic, so that a filter on its result does not run it a second time.
    """
    q = np.asarray(query, np.float64)
    size = np.sqrt(q @ q)

    @F.arrow_udf("double")
    def distance(v: pa.Array) -> pa.Array:
        flat, offsets = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), v.offsets.to_numpy()
        lens, out = np.diff(offsets), np.full(len(v), np.nan)
        lens[np.asarray(v.is_null())] = 0
        rows = np.flatnonzero(lens == len(q))
        if len(rows):
            m = flat[(offsets[rows] - offsets[0])[:, None] + np.arange(len(q))]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[rows] = 1 - (m @ q) / (np.sqrt(np.einsum("ij,ij->i", m, m)) * size)
        return pa.array(out, mask=~np.isfinite(out))

    return distance.asNondeterministic()


def top_k_cosine(base: DataFrame, query: DataFrame, k: int, id_col: str, vector: str, digits: int = 6) -> DataFrame:
    """The k rows of base nearest to the one row of query, by cosine distance (rounded), ties by id.

    The query is one vector, so it is sent with the function; each batch of base is one matrix product,
    and every task keeps k rows.
    """
    from gondola.functions.exprs import half_up

    q = query.select(F.col(vector).cast("array<double>").alias("q")).first()
    if q is None or not q["q"]:
        return base.withColumn("distance", F.lit(None).cast("double")).limit(0)
    near = base.withColumn("distance", half_up(distance_to(q["q"])(vector), digits)).where("distance is not null")
    return near.orderBy("distance", id_col).limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns, for pairs of rows."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
