"""Models on rows whose label follows one feature: judged against a plain AUC, a shuffled target and the other features."""

import random

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors

from gondola.operators import models


def rows(spark):
    rng = random.Random(3)
    out = []
    for k in range(900):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        out.append((k, k % 3 != 0, float(a + rng.gauss(0, 0.3) > 0), a, b if k % 50 else None))
    return spark.createDataFrame(out, "k int, train boolean, label double, a double, b double")


def test_models_find_what_is_there(spark):
    x = rows(spark)
    got = {r["model"]: r for r in models.direction_scores(x, ["a", "b"], ["k"]).collect()}
    assert set(got) == {"logistic", "forest", "boosted"}
    test = [(r["label"], r["a"]) for r in x.where("not train and b is not null").collect()]
    up, down = (np.array([a for y, a in test if y == v]) for v in (1.0, 0.0))
    plain = np.mean(up[:, None] > down[None, :])  # the order of the one feature that matters
    assert abs(got["logistic"]["auc"] - plain) < 0.01 and all(r["auc"] > 0.9 and r["f1"] > 0.85 for r in got.values())
    assert all(0.35 < r["shuffled_auc"] < 0.65 for r in got.values())
    folds = models.fold_scores(x, ["a", "b"], ["k"]).collect()
    assert sum(r["rows"] for r in folds) == x.where("b is not null").count() and all(abs(r["auc"] - plain) < 0.05 for r in folds)
    first, second = models.importance(x, ["a", "b"]).collect()
    assert (first["feature"], second["feature"]) == ("a", "b") and first["importance"] > 0.8


def test_auc_is_that_of_pairs(spark):
    scores = [(0.9, 1.0), (0.8, 0.0), (0.7, 1.0), (0.3, 0.0), (0.2, 1.0), (0.1, 0.0)]
    x = spark.createDataFrame([(Vectors.dense([1 - s, s]), y) for s, y in scores], ["rawPrediction", "label"])
    assert abs(BinaryClassificationEvaluator(labelCol="label").evaluate(x) - 6 / 9) < 1e-9
