"""Medians of large groups are those of the SQL, and many products cost as much as one."""

import datetime
import time

from pyspark.sql import functions as F

from gondola.operators.windows import middle, once
from gondola.plans import facts, pricing
from gondola.sources import tables


def shelf(spark, n: int, parts: int):
    """One store, category and month with n products, dealt over tasks: no two prices are alike."""
    p = 100 + F.pmod(F.col("id") * 7919, F.lit(n)) * 0.001
    return spark.range(0, n, 1, parts).select(
        F.lit(1).cast("long").alias("store_id"), F.lit("SMALL").alias("category"), F.col("id").alias("product_id"), F.lit("red x").alias("description"), F.expr("date'1995-01-01'").alias("month"),
        p.alias("price"), F.when(F.col("id") % 3 == 0, p * 0.9).alias("promo"), (p + 1).alias("list_price"), F.lit("R").alias("flag"))


def lower(values: list[float]) -> float:
    return sorted(values)[(len(values) + 1) // 2 - 1]


def test_exact_medians(spark):
    for n in (20_001, 60_000):
        x = shelf(spark, n, 16).cache()
        rows = x.select("price", "promo", "list_price").collect()
        own, rival = facts.own_cells(x).first(), facts.rival_cells(x).first()
        m = lower([r["price"] for r in rows])
        assert own["m"] == m and abs(own["price"] - m) < 1e-4 and own["products"] == own["n"] == n
        assert abs(own["paid"] - lower([r["promo"] or r["price"] for r in rows])) < 1e-4
        assert abs(rival["competitor"] - lower([r["list_price"] for r in rows])) < 1e-4 and rival["rival_n"] == n
        x.unpersist()


def test_medians_of_odd_groups(spark):
    rows = [("even", 4.0), ("even", 1.0), ("even", 3.0), ("even", 2.0), ("ties", 5.0), ("ties", 5.0), ("ties", 9.0), ("gaps", None), ("gaps", 7.0), ("none", None), (None, 8.0), (None, 6.0), (None, 7.5)]
    x = spark.createDataFrame(rows, "k string, v double").withColumn("mid", middle(F.col("v"), ["k"]))
    got = {r["k"]: r["m"] for r in x.groupBy("k").agg(F.max("mid").alias("m")).collect()}
    assert got == {"even": 2.0, "ties": 5.0, "gaps": 7.0, "none": None, None: 7.5}


def test_once(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("a", None), ("b", None), (None, 3), (None, 3), (None, None), (None, 4)]
    x = spark.createDataFrame(rows, "k string, v long").withColumn("fresh", once(F.col("v"), ["k"]))
    assert {r["k"]: r["n"] for r in x.groupBy("k").agg(F.count_if("fresh").alias("n")).collect()} == {"a": 2, "b": 0, None: 2}


def test_shelves_keep_no_state_of_each_product(spark, tmp_path):
    """A distinct count beside the means shuffled sums of every product and month; now each is one row a shelf."""
    part = "part_key long, p_type string, p_name string, p_retailprice double"
    spark.createDataFrame([(1, "SMALL", "red x", 9.0), (2, "SMALL", "old y", 9.0), (3, None, "z", 9.0)], part).withColumnRenamed("part_key", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    line = "l_suppkey long, l_partkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string"
    day = datetime.datetime(1995, 2, 3)
    lines = [(s, p, day, 10.0 * p, 2.0, 0.0, "R") for s, p in ((1, 1), (1, 1), (21, 2), (2, 3), (2, 3), (None, 2))]
    spark.createDataFrame(lines, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["store_id"], r["category"]): (r["n_products"], r["n_items"]) for r in facts.shelves(spark, str(tmp_path)).collect()}
    assert got == {(1, "SMALL"): (2, 3), (2, None): (1, 2), (None, "SMALL"): (1, 1)}
    plan = facts.shelved(tables.conformed(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan


def test_many_products_cost_as_much_as_one(spark):
    """Each product of a cell had a sketch of its own, and these were merged one by one: the work grew with the square of the rows."""
    took = {}
    for products in (7, 1, 60_000):  # the first warms up
        x = shelf(spark, 60_000, 4).withColumn("product_id", F.col("product_id") % products)
        start = time.time()
        assert facts.own_cells(x).select("price", "paid", "products").first()["products"] == products
        took[products] = time.time() - start
    assert took[60_000] < 4 * took[1] + 2


def test_exact_unit_prices(spark, tmp_path):
    """The anchor month of a store has 24,000 rows of one category, each with a price of its own."""
    n = 24_000
    price = 100 + F.pmod(F.col("id") * 7919, F.lit(n)) * 0.001
    lines = spark.range(0, n, 1, 16).select(
        F.lit(1).cast("long").alias("l_suppkey"), (F.col("id") * 10).alias("l_partkey"), F.expr("timestamp_ntz'1995-02-03 00:00:00'").alias("l_shipdate"), (price * 2).alias("l_extendedprice"),
        F.lit(2.0).alias("l_quantity"), F.lit(0.0).alias("l_discount"), F.lit("R").alias("l_returnflag"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = spark.range(n).select((F.col("id") * 10).alias("p_partkey"), F.lit("SMALL").alias("p_type"), F.lit("red x").alias("p_name"), F.lit(4).alias("p_size"), F.lit(90.0).alias("p_retailprice"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    units = pricing.anchored(spark, str(tmp_path))[1].collect()
    want = lower([r[0] for r in lines.select(F.col("l_extendedprice") / 2 / 4).collect()])
    assert [(r["store_id"], r["category"], r["unit_name"], r["unit_coverage"]) for r in units] == [(1, "SMALL", "fl_oz", 100.0)]
    assert abs(units[0]["unit_price"] - want) < 1e-4
