"""Readers of scores alone: they get the queue's rows without the price marts."""

import math
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from gondola.plans import facts, marts, pricing, scores, serving
from gondola.sources import snapshots, workspace

SF = "/root/testdata/sf0.001"
TABLES = ("part", "orders", "lineitem", "events", "supplier", "nation")
READERS = ["score_distributions", "score_histogram", "score_boxes", "corr_matrix", "spearman", "expansion_avg", "avg_confidence", "trailing_year", "demand_heatmap"]


def canon(rows):
    one = lambda v: ("null",) if v is None or (isinstance(v, float) and math.isnan(v)) else (type(v).__name__, round(v, 9) + 0.0 if isinstance(v, float) else v)
    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Stores 3 and 4 are listed twice, a store in no nation and 5 are not listed at all."""
    sf = tmp_path_factory.mktemp("scored")
    for t in TABLES:
        shutil.copy(f"{SF}/{t}.parquet", sf / f"{t}.parquet")
    s = spark.read.parquet(f"{SF}/supplier.parquet")
    twice = s.where("s_suppkey in (3, 4)").withColumn("s_name", F.lit("again"))
    nowhere = F.when(F.col("s_suppkey") == 6, F.lit(99)).otherwise(F.col("s_nationkey")).cast("int")
    rows = s.where("s_suppkey <> 5").withColumn("s_nationkey", nowhere).unionByName(twice).toPandas()
    spark.createDataFrame(rows, s.schema).coalesce(1).write.mode("overwrite").parquet(str(sf / "suppliers"))
    (sf / "supplier.parquet").unlink()
    (sf / "suppliers").rename(sf / "supplier.parquet")
    return str(sf)


def test_scores_need_no_prices(spark, folder):
    """All price marts were built for the means of scores that stand two steps before them."""
    workspace.forget(spark, folder)
    assert {r["score"] for r in marts.QUERIES["score_distributions"](spark, folder).collect()} == {"demand", "shelf_risk", "confidence", "ready", "margin_risk", "momentum", "intent"}
    built = lambda m: snapshots.manifest(spark, workspace.mart_path(spark, folder, m.__name__)) is not None
    assert built(scores.ready)
    assert not any(map(built, (facts.own_prices, facts.prices, pricing.pricing, serving.actions, serving.queue)))


def test_scored_rows_are_those_of_the_queue(spark, folder):
    names = [*facts.KEYS, "demand", "shelf_risk", "confidence", "ready", "margin_risk", "momentum", "intent"]
    got, want = (canon(x.select(*names).collect()) for x in (serving.scored(spark, folder), serving.queue(spark, folder)))
    assert got == want and len(set(got)) < len(got)


@pytest.mark.parametrize("name", READERS)
def test_readers_of_odd_stores(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'/*.parquet' if t == 'supplier' else ''}'")
    found = marts.QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    want = con.execute(f"select {', '.join(columns)} from ({marts.ORACLE[name]})").fetchall()
    assert canon(found.select(*columns).collect()) == canon(want)
