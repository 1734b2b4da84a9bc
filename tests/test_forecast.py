"""The recursive lag forecast and the audits, each against plain code or a planted answer."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.operators.forecast import lag_forecast
from gondola.operators.models import audited, shuffled

DAY = date(2026, 1, 1)


def plain(values, lags, steps, low=0.0):
    train = [np.nan if v is None else v for v in values[:-steps]]
    train = np.where(np.isnan(train), np.nanmedian(train), train)
    deep = max(lags)
    x = np.array([[1.0, *(train[i - n] for n in lags)] for i in range(deep, len(train))])
    coefs = np.linalg.lstsq(x, train[deep:], rcond=None)[0]
    held = train[-deep:].tolist()
    for _ in range(steps):
        held.append(max(low, float(coefs @ [1.0, *(held[-n] for n in lags)])))
    return held[deep:]


@pytest.mark.parametrize("lags,steps", [((1, 4), 8), ((1, 2, 7), 10), ((2,), 3)])
def test_lag_forecast(spark, lags, steps):
    rng = np.random.default_rng(1)
    series = {c: [None if rng.random() < 0.05 and k < 50 else float(20 + 5 * np.sin(k / 3 + i) + rng.normal()) for k in range(60)] for i, c in enumerate("abc")}
    series["flat"], series["short"] = [7.0] * 30, [1.0] * steps
    rows = [(c, DAY + timedelta(k), v) for c, own in series.items() for k, v in enumerate(own)]
    got = {}
    for r in lag_forecast(spark.createDataFrame(rows, "c string, d date, v double").repartition(3), "c", "d", "v", lags, steps).orderBy("d").collect():
        got.setdefault(r.c, []).append(r.forecast)
    for c in "abc":
        assert got[c] == pytest.approx(plain(series[c], lags, steps), rel=1e-6)
    assert set(got["flat"]) == set(got["short"]) == {None} and len(got["short"]) == steps


def test_later_values_do_not_leak(spark):
    """Values of the days that are foretold change no forecast."""
    rng = np.random.default_rng(2)
    values = [float(v) for v in rng.normal(50, 5, 40)]
    told = []
    for last in (values[-8:], [1e6, None] * 4):
        rows = [("a", DAY + timedelta(k), v) for k, v in enumerate(values[:-8] + last)]
        told.append([r.forecast for r in lag_forecast(spark.createDataFrame(rows, "c string, d date, v double"), "c", "d", "v").orderBy("d").collect()])
    assert told[0] == told[1]


@pytest.fixture(scope="module")
def panel(spark):
    """A label of noise, a column that leaks it, one that is noise, gaps and a text."""
    x = spark.range(1500).select((F.col("id") % 25).alias("store_id"), F.floor(F.col("id") / 25).alias("week"), (F.pmod(F.xxhash64("id"), F.lit(10)) < 3).cast("double").alias("label"), F.col("id"))
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000
    return x.select("*", (F.col("label") * 10 + noise(1)).alias("leak"), F.when(noise(2) > 0.1, noise(3)).alias("gappy"), F.when(noise(4) > 0.5, "x").otherwise("y").alias("kind"), noise(5).alias("plain"))


def test_a_planted_leak_is_found(spark, panel):
    got = {r.feature_set: r for r in audited(panel, {"all": ["leak", "gappy", "kind", "plain"], "masked": ["gappy", "kind", "plain"]}, "store_id", ["store_id", "week"], folds=2, trees=6).collect()}
    leaky, masked = got["all"], got["masked"]
    assert leaky.auc > 0.99 and leaky.fold_auc > 0.99 and leaky.f1 > 0.95
    assert 0.3 < masked.auc < 0.7 and 0.35 < masked.fold_auc < 0.65  # its mask removes it
    assert 0.2 < leaky.shuffled_auc < 0.8 and (leaky.features, masked.features) == (4, 3) and 0 < leaky.test_rows < 1500


def test_shuffled_labels(spark, panel):
    x = shuffled(panel, "label", ["store_id", "week"], 7).select("label", "shuffled", "id").collect()
    assert len(x) == 1500 and sum(r.label for r in x) == sum(r.shuffled for r in x)
    assert 0.4 < np.mean([r.label == r.shuffled for r in x]) < 0.75


def test_one_label(spark, panel):
    """Without two labels nothing is learnt, and nothing breaks."""
    got = audited(panel.withColumn("label", F.lit(1.0)), {"plain": ["plain"]}, "store_id", ["store_id", "week"], folds=2, trees=2).first()
    assert got.auc is None and got.f1 is None and got.fold_auc is None
