"""Bytes to read, told from footers, against what Spark reads."""

import pytest
from pyspark.sql import functions as F

from gondola.plans import serving
from gondola.sources import costs

SF = "/root/testdata/sf0.1"
QUESTIONS = {
    "two columns": lambda s: s.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_returnflag").agg(F.sum("l_extendedprice")),
    "filter without bounds": lambda s: s.read.parquet(f"{SF}/lineitem.parquet").where("l_quantity > 10").agg(F.sum("l_extendedprice"), F.max("l_shipdate")),
    "join": lambda s: s.read.parquet(f"{SF}/orders.parquet").join(s.read.parquet(f"{SF}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice")),
    "texts": lambda s: s.read.parquet(f"{SF}/documents.parquet").agg(F.sum(F.length("text"))),
    "vectors": lambda s: s.read.parquet(f"{SF}/embeddings.parquet").agg(F.sum(F.size("embedding")), F.max(F.element_at("embedding", 1)))}


def bytes_read(spark, df):
    """Input bytes of the stages that df runs."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        every = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return [every.apply(k) for k in range(every.size())]

    done = {s.stageId() for s in stages()}
    name = "parquet.hadoop.vectored.io.enabled"  # ranges that are read that way are not counted
    spark.conf.set(name, "false")
    try:
        df.collect()
    finally:
        spark.conf.unset(name)
    return sum(s.inputBytes() for s in stages() if s.stageId() not in done)


@pytest.mark.parametrize("name", sorted(QUESTIONS))
def test_estimates(spark, name):
    df = QUESTIONS[name](spark)
    guess = costs.estimated_bytes(df)
    got = bytes_read(spark, QUESTIONS[name](spark))
    assert guess == pytest.approx(got, rel=0.2)


def test_row_groups_left_out(spark, tmp_path):
    spark.range(100_000).select("id", F.col("id").cast("string").alias("s"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 100).cast("int")).alias("d")).coalesce(1).write.option("parquet.block.size", 100_000).parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    whole = costs.estimated_bytes(t)
    assert 0 < costs.estimated_bytes(t.where("id > 99990")) < whole / 2
    assert costs.estimated_bytes(t.where("id = -5")) == 0 and costs.estimated_bytes(t.where("d > '2021-01-01'")) == 0
    assert costs.estimated_bytes(t.select("id")) < whole and costs.estimated_bytes(spark.range(5)) == 0


def test_nothing_over_the_cap_starts(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{SF}/lineitem.parquet").createOrReplaceTempView("lines_to_ask")
    with pytest.raises(costs.TooMuch):
        serving.asked(spark, "select l_returnflag, count(*) from lines_to_ask where l_quantity > :q group by all", 10, most_bytes=1000, q=5)
    assert serving.asked(spark, "select l_returnflag, count(*) as n from lines_to_ask group by all", 10).count() == 3
