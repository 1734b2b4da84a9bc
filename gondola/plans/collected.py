"""What the collectors bring: answers made of the tables `events` and `pages`, fetched, gated, kept and taken apart.

Stored answers stand in for the remote sources: the daily numbers of a search term, a month an answer, and the pages of a
site, a block of them an answer.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.plans.registry import query
from gondola.sources import records
from gondola.sources.collect import Gate, collect, latest
from gondola.sources.tables import table
from gondola.sources.workspace import scratch

#: Pages of one answer.
BLOCK = 256


def term_answers(spark: SparkSession, sf: str) -> DataFrame:
    """(source, key, body): an answer for each term and month, with one point a day."""
    daily = table(spark, sf, "events").where("event_type is not null and ts is not null").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    point = F.struct(F.col("day").cast("string").alias("date"), F.col("n").cast("string").alias("value"), F.lit(False).alias("isPartial"))
    month = F.date_format("day", "yyyy-MM")
    return daily.groupBy(F.lit("terms").alias("source"), F.concat_ws(" ", "event_type", month).alias("key")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(point)).alias("points"))).alias("body"))


def page_answers(spark: SparkSession, sf: str) -> DataFrame:
    """(source, key, body): an answer for each block of pages."""
    page = F.struct(F.col("page_id"), F.col("url"), F.col("html"))
    return table(spark, sf, "pages").groupBy(F.lit("pages").alias("source"), F.concat(F.lit("block "), F.coalesce(F.floor(F.col("page_id") / BLOCK).cast("string"), F.lit("without number"))).alias("key")).agg(
        F.to_json(F.struct(F.collect_list(page).alias("pages"))).alias("body"))


def _kept(spark: SparkSession, made: DataFrame, name: str, gate: Gate) -> DataFrame:
    """The answers, stored as a source would have them, and then collected."""
    root, path = scratch(spark, f"{name}-source"), scratch(spark, f"{name}-answers")
    made.write.partitionBy("source", "key").text(root)
    requests = made.select("source", "key")
    collect(spark, requests, root, path, date(2024, 1, 1), gate=gate, requestsPerTask=16)
    return latest(spark, path)


@query("SELECT event_type AS keyword, CAST(ts AS DATE) AS trend_date, count(*) AS interest_score FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL")
def collected_terms(spark, sf):
    """Daily numbers of all terms, through requests, answers and their parser."""
    found = _kept(spark, term_answers(spark, sf), "terms", Gate(required=("terms",)))
    asked = found.select(F.substring_index("key", " ", 1).alias("keyword"), F.lit(None).cast("string").alias("category"), "body")
    return records.trends(asked).select("keyword", "trend_date", "interest_score")


@query("SELECT page_id, url, length(html) AS chars FROM pages")
def collected_pages(spark, sf):
    """All pages, a block an answer."""
    found = _kept(spark, page_answers(spark, sf), "pages", Gate(required=("pages",)))
    page = F.explode(F.from_json("body", "pages array<struct<page_id:bigint,url:string,html:string>>")["pages"])
    return found.select(page.alias("p")).select("p.page_id", "p.url", F.char_length("p.html").cast("long").alias("chars"))
