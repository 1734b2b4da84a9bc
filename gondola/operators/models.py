"""Classifiers of a direction, judged on later rows and against a shuffled target."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.operators.windows import numbered
from gondola.sources.workspace import stored


def candidates(seed: int) -> dict:
    return {
        "logistic": LogisticRegression(featuresCol="x", maxIter=30, regParam=0.01),
        "forest": RandomForestClassifier(featuresCol="x", numTrees=20, maxDepth=5, seed=seed),
        "boosted": GBTClassifier(featuresCol="x", maxIter=10, maxDepth=3, seed=seed)}


def direction_scores(rows: DataFrame, features: list[str], keys: list[str], seed: int = 7) -> DataFrame:
    """(model, auc, f1, shuffled_auc) on the rows that are not `train`.

    The shuffled target is a coin by the digest of a row's keys: a model that does
    well on it leaks.  Rows with a null feature are not used.
    """
    spark = rows.sparkSession
    coin = (F.pmod(F.xxhash64(*keys), F.lit(2)) == 0).cast("double")
    ready = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(rows.withColumn("coin", coin)).select("train", "label", "coin", "raw")
    held = stored(ready, "models")
    train, test = held.where("train"), held.where("not train")
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
    train_x, test_x = scaler.transform(train), scaler.transform(test)
    found = []
    for name, model in candidates(seed).items():
        judged = model.setLabelCol("label").fit(train_x).transform(test_x)
        by_coin = model.setLabelCol("coin").fit(train_x).transform(test_x)
        auc = BinaryClassificationEvaluator(labelCol="label").evaluate(judged)
        f1 = MulticlassClassificationEvaluator(labelCol="label", metricName="f1").evaluate(judged)
        found.append((name, round(auc, 4), round(f1, 4), round(BinaryClassificationEvaluator(labelCol="coin").evaluate(by_coin), 4)))
    return spark.createDataFrame(found, "model string, auc double, f1 double, shuffled_auc double")


def fold_scores(rows: DataFrame, features: list[str], keys: list[str], folds: int = 3, seed: int = 7) -> DataFrame:
    """(fold, rows, auc) of the logistic model: each fold, dealt by the digest of a row's keys, is judged by a model of the others."""
    ready = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(rows).select("label", "raw", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(folds)).alias("fold"))
    held, found = stored(ready, "model-folds"), []
    for fold in range(folds):
        train, test = held.where(F.col("fold") != fold), held.where(F.col("fold") == fold)
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
        model = candidates(seed)["logistic"].setLabelCol("label").fit(scaler.transform(train))
        found.append((fold, test.count(), round(BinaryClassificationEvaluator(labelCol="label").evaluate(model.transform(scaler.transform(test))), 4)))
    return rows.sparkSession.createDataFrame(found, "fold int, rows long, auc double")


def importance(rows: DataFrame, features: list[str], seed: int = 7) -> DataFrame:
    """(feature, importance) of the forest over all rows, the most important first."""
    ready = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip").transform(rows).select("label", "x")
    weights = candidates(seed)["forest"].setLabelCol("label").fit(ready).featureImportances
    ranked = sorted(zip(features, (round(float(w), 4) for w in weights.toArray())), key=lambda p: (-p[1], p[0]))
    return rows.sparkSession.createDataFrame(ranked, "feature string, importance double")


# --- audits ---------------------------------------------------------------------------------------


def audit_pipeline(rows: DataFrame, features: list[str], label: str, trees: int, seed: int) -> Pipeline:
    """Texts as numbers, gaps as medians, a forest: all fitted on the training rows that it gets, so that nothing of the others gets in."""
    kinds = dict(rows.dtypes)
    texts = [f for f in features if kinds[f] == "string"]
    numbers = [f for f in features if f not in texts]
    stages: list = [StringIndexer(inputCols=texts, outputCols=[f"{f}#" for f in texts], handleInvalid="keep")] if texts else []
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=[f"{f}#" for f in numbers], strategy="median"))
    assemble = VectorAssembler(inputCols=[f"{f}#" for f in features], outputCol="x")
    return Pipeline(stages=[*stages, assemble, RandomForestClassifier(featuresCol="x", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=4, maxBins=256, seed=seed)])


def shuffled(rows: DataFrame, label: str, keys: list[str], seed: int) -> DataFrame:
    """rows with `shuffled`: the labels of all rows in another order, so their shares stay."""
    order = lambda k: [F.xxhash64(F.lit(seed + k), *keys), *map(F.col, keys)]
    mine = numbered(rows, order(0), "_n")
    others = numbered(rows.select(F.col(label).alias("shuffled"), *keys), order(1), "_n").drop(*keys)
    return mine.join(others, "_n").drop("_n")


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with a weight by which both labels count alike."""
    n = rows.agg(F.count("*").alias("n"), F.sum(label).alias("ones"))  # one row
    share = F.when(F.col(label) == 1, F.col("ones")).otherwise(F.col("n") - F.col("ones"))
    return rows.crossJoin(F.broadcast(n)).withColumn("weight", F.coalesce(F.try_divide(F.col("n"), 2 * share), F.lit(1.0))).drop("n", "ones")


def judged(train: DataFrame, test: DataFrame, features: list[str], label: str, trees: int, seed: int, truth: str | None = None) -> dict:
    """auc, precision, recall, f1 on test of a model of train; auc is None where test has one label, all are where train has."""
    truth = truth or label
    none = dict.fromkeys(("auc", "precision", "recall", "f1"))
    if train.select(label).distinct().count() < 2 or test.isEmpty():
        return none
    found = audit_pipeline(train, features, label, trees, seed).fit(balanced(train, label)).transform(test.withColumn("weight", F.lit(1.0))).select(truth, "rawPrediction", "prediction")
    held = {(r[0], r[1]): r[2] for r in found.groupBy(truth, "prediction").count().collect()}  # four cells
    hit, wrong, missed = held.get((1.0, 1.0), 0), held.get((0.0, 1.0), 0), held.get((1.0, 0.0), 0)
    precision, recall = hit / max(hit + wrong, 1), hit / max(hit + missed, 1)
    both = len({t for t, _ in held}) == 2
    auc = BinaryClassificationEvaluator(labelCol=truth).evaluate(found) if both else None
    return {"auc": auc, "precision": precision, "recall": recall, "f1": 2 * precision * recall / max(precision + recall, 1e-12)}


AUDITED = "feature_set string, features int, test_rows long, auc double, precision double, recall double, f1 double, fold_auc double, fold_spread double, shuffled_auc double"


def audited(rows: DataFrame, sets: dict[str, list[str]], group: str, keys: list[str], folds: int = 3, trees: int = 20, seed: int = 7, hold: int = 5) -> DataFrame:
    """(AUDITED) one row a feature set: judged on the groups that are held out (about one of `hold`), over folds of rows, and with shuffled labels against the true ones.

    A set that contains the answer stands out against one without it; a shuffled target that is foretold
    says that rows leak by their place.  Numbers are cast to double; rows without a label are left out.
    """
    spark = rows.sparkSession
    every = sorted({f for s in sets.values() for f in s})
    kinds = dict(rows.dtypes)
    typed: list[Column] = [F.col(f) if kinds[f] == "string" else F.col(f).cast("double").alias(f) for f in every]
    part = lambda n, *by: F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(n))
    names = [k for k in keys if k not in every]
    base = rows.where("label is not null").select(*typed, *names, *([group] if group not in [*every, *names] else []), F.col("label").cast("double").alias("label"))
    held = stored(shuffled(base, "label", keys, seed).withColumns({"held": part(hold, group) == 0, "fold": part(folds, *keys)}), "audit")
    train, test = held.where("not held"), held.where("held")
    n = test.count()
    digits = lambda v: None if v is None else round(float(v), 4)
    found = []
    for name, features in sets.items():
        main = judged(train, test, features, "label", trees, seed)
        by_fold = [v for k in range(folds) if (v := judged(held.where(F.col("fold") != k), held.where(F.col("fold") == k), features, "label", trees, seed)["auc"]) is not None]
        mean = sum(by_fold) / len(by_fold) if by_fold else None
        spread = (sum((v - mean) ** 2 for v in by_fold) / len(by_fold)) ** 0.5 if by_fold else None
        chance = judged(train, test, features, "shuffled", trees, seed, truth="label")["auc"]
        found.append((name, len(features), n, *(digits(main[k]) for k in ("auc", "precision", "recall", "f1")), digits(mean), digits(spread), digits(chance)))
    return spark.createDataFrame(found, AUDITED)
