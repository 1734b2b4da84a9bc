"""Conformed inputs: raw tables as retail observations, indices and interest.

Stand-ins on the test tables: part types are shelf categories, suppliers modulo 20 are stores, rows with return flag R
are what a competitor's feed brings, two order priorities are the producer and the consumer index, event types are search terms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.config import T
from gondola.sources.workspace import mart

#: Stand-ins: part types as shelf categories, and the search term of each (one category is not searched for).
SHELF = {"ECONOMY": "household", "LARGE": "dairy", "MEDIUM": "snacks", "PROMO": "beverages", "SMALL": "coffee tea", "STANDARD": "meat seafood"}
TERMS = {"ECONOMY": "click", "LARGE": "error", "MEDIUM": "purchase", "PROMO": "signup", "SMALL": "view"}
#: Stand-ins for a retailer's own brands: how descriptions start.
OWN_BRANDS = ("red", "blue", "old")
#: Stand-ins for the series of the producer and of the consumer index.
PRODUCER, CONSUMER = "1-URGENT", "2-HIGH"
STORES = 20
#: Stand-in: stores of the competitor (the numbers of its feed modulo this).
RIVAL_STORES = 1

#: Price sensitivity and premium prior of a category, and how far a rival's price bears on it.
SENSITIVITY = {
    "beverages": ("Low", 70), "snacks": ("Medium", 55), "dairy": ("High", 30), "frozen foods": ("High", 35), "breakfast cereal": ("Medium", 55),
    "meat seafood": ("High", 30), "produce": ("High", 25), "personal care": ("Low", 75), "household": ("High", 35), "coffee tea": ("Low", 80)}
RELEVANCE = {
    "household": "High", "produce": "High", "dairy": "High", "frozen foods": "High", "breakfast cereal": "Medium", "snacks": "Medium",
    "beverages": "Low", "coffee tea": "Low", "personal care": "Low", "meat seafood": "Low"}
PARENT = {"personal care": "Health & Beauty", "household": "Household"} | {
    k: "Food & Beverage" for k in ("beverages", "snacks", "dairy", "frozen foods", "breakfast cereal", "meat seafood", "produce", "coffee tea")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def within(day: Column, months: list[str | None]) -> Column:
    """Is a time in one of these months (first days as text; None: no time)?  Ranges, which reach the scan."""
    start = lambda m: F.lit(m).cast("timestamp")
    held = [(day >= start(m)) & (day < F.add_months(F.lit(m).cast("date"), 1).cast("timestamp")) if m else day.isNull() for m in months]
    return reduce(lambda a, b: a | b, held, F.lit(False))


def retail(spark: SparkSession, sf_dir: str, months: list[str | None] | None = None) -> DataFrame:
    """Shelf prices: product x store x category x day."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    if months is not None:
        line = line.where(within(F.col("l_shipdate"), months))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        (F.col("l_suppkey") % STORES).alias("store_id"), F.col("p_type").alias("category"), F.col("l_partkey").alias("product_id"),
        F.col("p_name").alias("description"), F.to_date("l_shipdate").alias("day"),
        F.trunc(F.to_date("l_shipdate"), "MONTH").alias("month"), price.alias("price"),
        F.when(F.col("l_discount") >= 0.05, price * (1 - F.col("l_discount"))).alias("promo"),
        F.col("p_retailprice").alias("list_price"), F.col("l_returnflag").alias("flag"))


@mart("month", "category", grows="month", places={"lineitem": "trunc(to_date(l_shipdate), 'MONTH')"})
def conformed(spark: SparkSession, sf_dir: str, months: list[str | None] | None = None) -> DataFrame:
    """retail(), joined once and stored: what the price facts and monthly shelves are made of.  months: of these alone, pruned by statistics of l_shipdate."""
    return retail(spark, sf_dir, months)


def producer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price indices: series x month."""
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("series_id"), F.trunc(F.to_date("o_orderdate"), "MONTH").alias("month")).agg(
        F.avg("o_totalprice").alias("value"))


def index(spark: SparkSession, sf_dir: str, series: str, name: str) -> DataFrame:
    """One index, one row a month, on the scale that the scores expect."""
    return producer_index(spark, sf_dir).where(F.col("series_id") == series).select("month", (F.col("value") / T.index_scale).alias(name))


def interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search interest: term x day."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category"), F.to_date("ts").alias("day")).agg(
        F.avg("value").alias("interest"))


def item_size(part: Column, size: Column) -> Column:
    """Stand-in for the size text of a product: good and bad forms by its key."""
    s, k = size.cast("string"), part % 10
    forms = [F.concat(s, F.lit(" fl oz")), F.concat(F.lit("24 bottles / "), s, F.lit(" oz")), F.concat(s, F.lit(".5 L")), F.concat(F.lit("8 oz / "), s, F.lit(" oz")),
             F.concat(s, F.lit("ct")), F.lit(""), F.concat(s, F.lit(" dozen")), F.lit("0 lbs"), F.concat(F.lit("  "), s, F.lit(" Pounds "))]
    out = F.when(k == 0, forms[0])
    for n, form in enumerate(forms[1:], 1):
        out = out.when(k == n, form)
    return out.otherwise(F.concat(F.lit("6 cans / "), s, F.lit(" fluid ounces")))


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: when each source was last collected."""
    line = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("retail"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("rival"))
    orders = table(spark, sf_dir, "orders").agg(*[F.max(F.when(F.col("o_orderpriority") == s, F.col("o_orderdate"))).alias(n) for s, n in ((PRODUCER, "producer"), (CONSUMER, "consumer"))])
    terms = table(spark, sf_dir, "events").agg(F.max("ts").alias("terms"))
    return line.crossJoin(orders).crossJoin(terms)  # three aggregates without keys: one row each
