"""Answers of remote sources as rows, without the network: each function takes a column of JSON text.

What a collector fetched is a table of answers (`body` and what it was asked for);
from_json with a fixed schema and try_cast take it apart, so a malformed answer gives no rows rather than an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.exprs import price_text
from gondola.sources.workspace import stored


class Incomplete(ValueError):
    """Too few answers came in, or the one that scoring needs is missing; nothing may be written."""


def trends(answers: DataFrame) -> DataFrame:
    """(keyword, category, trend_date, interest_score, is_partial): complete periods only.  answers: keyword, category, body."""
    points = F.from_json("body", "points array<struct<date:string,value:string,isPartial:boolean>>")["points"]
    x = answers.select("keyword", "category", F.explode(points).alias("p"))
    return x.where(~F.col("p.isPartial")).select(
        "keyword", "category", F.to_date("p.date").alias("trend_date"), F.col("p.value").try_cast("bigint").alias("interest_score"), F.col("p.isPartial").alias("is_partial"))


def index_values(answers: DataFrame, scoring: str, newest: int = 24) -> DataFrame:
    """(series_id, observation_date, value), the newest of each series; "." means no value.  answers: series_id, body.

    The scoring series must be there; supplementary ones may be missing.  Answers are stored before that is looked at, so they are fetched once.
    """
    answers = stored(answers, "answers")
    seen = F.from_json("body", "observations array<struct<date:string,value:string>>")["observations"]
    newest_first = F.slice(F.reverse(F.array_sort(seen)), 1, newest)
    x = answers.select("series_id", F.explode(newest_first).alias("o")).where("o.value <> '.'").select(
        "series_id", F.to_date("o.date").alias("observation_date"), F.col("o.value").try_cast("double").alias("value"))
    if x.where(F.col("series_id") == scoring).isEmpty():
        raise Incomplete(f"no values of {scoring}")
    return x


def consumer_values(answers: DataFrame) -> DataFrame:
    """(series_id, reference_date, period_code, value, is_suppressed, is_latest): "-" is a suppressed value.  answers: body."""
    series = F.from_json("body", "Results struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,value:string,latest:string>>>>>")["Results"]["series"]
    x = answers.select(F.explode(series).alias("s")).select(F.col("s.seriesID").alias("series_id"), F.explode("s.data").alias("d"))
    month = F.expr("try_cast(replace(d.period, 'M', '') as int)")
    return x.select(
        "series_id", F.make_date(F.expr("try_cast(d.year as int)"), month, F.lit(1)).alias("reference_date"), F.col("d.period").alias("period_code"),
        F.expr("try_cast(d.value as double)").alias("value"), (F.col("d.value") == "-").alias("is_suppressed"), F.coalesce(F.col("d.latest") == "true", F.lit(False)).alias("is_latest"))


def shelf_items(answers: DataFrame) -> DataFrame:
    """One row a product: its first item and first category.  answers: store_id, category, body."""
    item = "struct<size:string,soldBy:string,price:struct<regular:double,promo:double>>"
    data = F.from_json("body", f"data array<struct<productId:string,upc:string,brand:string,description:string,categories:array<string>,items:array<{item}>>>")["data"]
    x = answers.select("store_id", "category", F.explode(data).alias("p")).withColumn("i", F.get("p.items", F.lit(0)))
    return x.select(
        F.col("p.productId").alias("product_id"), "p.upc", "p.brand", "p.description", F.get("p.categories", F.lit(0)).alias("primary_category"),
        F.col("i.price.regular").alias("price_regular"), F.col("i.price.promo").alias("price_promo"), F.col("i.size").alias("item_size"), F.col("i.soldBy").alias("sold_by"),
        "store_id", "category")


def rival_items(answers: DataFrame, least_share: float = 0.8) -> DataFrame:
    """One row an offer that is in stock, not sponsored and has a price above 0.  answers: store_id, category, body (null: the call failed).

    The price is the primary offer's, else what the price text says; titles are cut to 500
    characters.  With fewer than least_share of the calls answered the batch is refused.
    """
    answers = stored(answers, "answers")  # fetched once: for the gate and for what comes after it
    calls = answers.agg(F.count("*").alias("n"), F.count("body").alias("ok")).first()
    if calls["ok"] < least_share * calls["n"]:
        raise Incomplete(f"{calls['ok']} of {calls['n']} calls answered")
    offer = ("title:string,product_id:string,us_item_id:string,sponsored:boolean,out_of_stock:boolean,price:string,"
             "primary_offer:struct<offer_price:string>,price_per_unit:struct<amount:string,unit:string>")  # fmt: skip
    x = answers.select("store_id", "category", F.explode(F.from_json("body", f"organic_results array<struct<{offer}>>")["organic_results"]).alias("r"))
    x = x.where(~F.coalesce("r.sponsored", F.lit(False)) & ~F.coalesce("r.out_of_stock", F.lit(False)))
    price = F.coalesce(F.nullif(F.col("r.primary_offer.offer_price").try_cast("double"), F.lit(0.0)), price_text(F.col("r.price")))
    return x.withColumn("competitor_price", price).where("competitor_price > 0").select(
        F.left("r.title", F.lit(500)).alias("product_name"), "store_id", "category", "competitor_price",
        price_text(F.col("r.price_per_unit.amount")).alias("price_per_unit"), F.col("r.us_item_id").alias("item_id"), F.col("r.product_id").alias("product_id"))


#: Characters without width, which some filings use as separators.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"


def filing_sections(filings: DataFrame, wanted: tuple[str, ...] = ("1", "1A", "7"), least: int = 200) -> DataFrame:
    """(id, item, text) of the wanted items of filings (id, text).

    An item starts at the first line that is its header ("ITEM n.") and ends at the next
    header in the document.  Lines without content, or with characters without width alone, part paragraphs.  An item
    that is missing or shorter than `least` is an error: partial content is not to be taken.
    """
    line = F.trim(F.translate(F.regexp_replace("line", "\u00a0", " "), ZERO_WIDTH, ""))
    lines = filings.select("id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("id", "at", line.alias("line"))
    header = F.upper(F.nullif(F.regexp_extract("line", r"(?i)^ITEM\s+(\d+[A-Z]?)\.\s*$", 1), F.lit("")))
    marked = lines.withColumn("item", header)
    first = marked.where("item is not null").groupBy("id", "item").agg(F.min("at").alias("start"))
    spans = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "item"))).alias("s")).select("id", F.posexplode("s").alias("k", "x"), "s").select(
        "id", "x.item", "x.start", F.get("s", F.col("k") + 1)["start"].alias("stop"))
    cut = lines.where("line <> ''").join(spans.where(F.col("item").isin(*wanted)), "id").where("at >= start and (stop is null or at < stop)")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n\n")
    found = filings.select("id", F.explode(F.array(*map(F.lit, wanted))).alias("item"))
    out = found.join(cut.groupBy("id", "item").agg(text.alias("text")), ["id", "item"], "left")
    broken = F.concat(F.lit("item "), F.col("item"), F.lit(" is missing or too short"))
    return out.select("id", "item", F.when(F.coalesce(F.char_length("text"), F.lit(0)) < least, F.raise_error(broken).cast("string")).otherwise(F.col("text")).alias("text"))


def series_record(series: DataFrame, least: int = 300) -> DataFrame:
    """(id, text): the description of a series as lines of text; null where it is shorter than `least`.  Unknown parts are named as such."""
    fields = [("Series ID", "id"), ("Title", "title"), ("Units", "units"), ("Frequency", "frequency"), ("Seasonal adjustment", "seasonal_adjustment"),
              ("Observations", "range"), ("Last updated", "last_updated"), ("Category", "category"), ("Tags", "tags"), ("Release", "release"), ("Notes", "notes")]
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("(none listed)"))) for label, c in fields]
    text = F.concat_ws("\n", *lines)
    return series.select("id", F.when(F.char_length(text) >= least, text).alias("text"))
