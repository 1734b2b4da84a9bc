"""Recursive forecasts from lags: normal equations summed by category, then a fold that feeds on its own forecasts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A system whose smallest singular value is below this part of the largest has no answer.
SINGULAR = 1e-9


def solved(sums: pd.Series, rights: pd.Series) -> pd.Series:
    """Coefficients of each small system (row by row, n x n); None where it is singular."""
    out = []
    for a, b in zip(sums, rights):
        m, y = np.array(a, float).reshape(len(b), len(b)), np.array(b, float)
        scale = np.linalg.svd(m, compute_uv=False) if np.isfinite(m).all() else np.zeros(1)
        out.append(np.linalg.solve(m, y).tolist() if scale[-1] > SINGULAR * scale[0] else None)
    return pd.Series(out)


def lag_forecast(x: DataFrame, by: str, at: str, value: str, lags: Sequence[int] = (1, 4), steps: int = 8, low: float = 0.0) -> DataFrame:
    """(by, at, value, forecast) of the last `steps` points of each series.

    Trained on the points before these: what is missing there, and in the lags, is the training part's own median.  The equations of all series are summed by
    Spark, with centred values, and solved a row a series; every step takes the forecasts of the steps before it as lags.
    Forecasts are `low` at least; a series that is too short, or whose lags do not differ, has none.
    """
    c, w = F.col, Window.partitionBy(by)
    ranked = x.select(by, at, F.col(value).cast("double").alias("v")).withColumn("k", F.row_number().over(w.orderBy(F.desc(at))))
    medians = ranked.where(c("k") > steps).groupBy(by).agg(F.median("v").alias("fill"))
    train = ranked.where(c("k") > steps).join(F.broadcast(medians), by).withColumn("v", F.coalesce("v", "fill"))  # one row a series
    lagged = train.select(by, "k", "v", *[F.lag("v", n).over(w.orderBy(F.desc("k"))).alias(f"l{n}") for n in lags]).dropna()
    names = [f"l{n}" for n in lags]
    # covariances: the normal equations with the constant taken out
    pairs = [F.covar_pop(a, b) for a in names for b in names]
    sums = lagged.groupBy(by).agg(F.array(*pairs).alias("a"), F.array(*[F.covar_pop(n, "v") for n in names]).alias("b"), F.avg("v").alias("mean"), F.array(*[F.avg(n) for n in names]).alias("means"))
    solve = F.pandas_udf(solved, "array<double>")
    models = sums.withColumn("coefs", solve("a", "b")).select(by, "coefs", (c("mean") - F.aggregate(F.zip_with("coefs", "means", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)).alias("start"))
    deep = max(lags)
    last = train.where(c("k") <= steps + deep).groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-c("k")).alias("o"), "v"))).alias("h"))  # as many values as the longest lag
    told = models.join(last, by).withColumn("f", _folded(F.transform("h", lambda s: s["v"]), c("coefs"), c("start"), lags, steps, low))
    ahead = told.select(by, F.posexplode("f").alias("i", "forecast")).select(by, (steps - c("i")).alias("k"), "forecast")
    return ranked.where(c("k") <= steps).join(ahead, [by, "k"], "left").select(by, at, c("v").alias(value), "forecast")


def _folded(history: Column, coefs: Column, start: Column, lags: Sequence[int], steps: int, low: float) -> Column:
    """The forecasts: each step looks back at an array to which the steps before have added theirs."""

    def step(held: Column, _: Column) -> Column:
        n = F.size(held)
        parts = [F.get(coefs, F.lit(i)) * F.get(held, n - lag) for i, lag in enumerate(lags)]
        return F.concat(held, F.array(F.greatest(F.lit(low), sum(parts, start))))

    whole = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), history, step)
    return F.when(coefs.isNotNull() & (F.size(history) == max(lags)), F.slice(whole, max(lags) + 1, steps))
