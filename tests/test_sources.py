"""Answers of sources as rows, files with a manifest, and sinks that leave nothing half done."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from gondola.plans import serving
from gondola.sources import records, sinks, workspace


def answers(spark, rows, schema):
    return spark.createDataFrame([(*r[:-1], r[-1] if r[-1] is None or isinstance(r[-1], str) else json.dumps(r[-1])) for r in rows], schema)


def test_trends(spark):
    body = {"points": [{"date": "2026-01-04", "value": 55, "isPartial": False}, {"date": "2026-01-11", "value": None, "isPartial": False}, {"date": "2026-01-18", "value": 60, "isPartial": True}]}
    x = answers(spark, [("k", "a", body), ("l", "b", None), ("m", "c", "not json")], "keyword string, category string, body string")
    assert sorted(tuple(r)[:4] for r in records.trends(x).collect()) == [("k", "a", date(2026, 1, 4), 55), ("k", "a", date(2026, 1, 11), None)]


def test_index_values(spark):
    body = lambda n: {"observations": [{"date": f"2026-{k:02d}-01", "value": "." if k == 2 else str(k)} for k in range(1, n + 1)]}
    x = answers(spark, [("S", body(5)), ("T", None)], "series_id string, body string")
    got = sorted((r["observation_date"].month, r["value"]) for r in records.index_values(x, "S", newest=4).collect())
    assert got == [(3, 3.0), (4, 4.0), (5, 5.0)]
    with pytest.raises(records.Incomplete):
        records.index_values(x, "T")


def test_consumer_values(spark):
    body = {"Results": {"series": [{"seriesID": "C", "data": [{"year": "2026", "period": "M01", "value": "320.5", "latest": "true"}, {"year": "2025", "period": "M12", "value": "-"}]}]}}
    got = {r["reference_date"]: r for r in records.consumer_values(answers(spark, [(body,)], "body string")).collect()}
    assert (got[date(2026, 1, 1)]["value"], got[date(2026, 1, 1)]["is_suppressed"], got[date(2026, 1, 1)]["is_latest"]) == (320.5, False, True)
    assert (got[date(2025, 12, 1)]["value"], got[date(2025, 12, 1)]["is_suppressed"], got[date(2025, 12, 1)]["is_latest"]) == (None, True, False)


def test_shelf_items(spark):
    body = {"data": [{"productId": "1", "categories": ["a", "b"], "items": [{"size": "12 oz", "soldBy": "UNIT", "price": {"regular": 3.5, "promo": 3.0}}, {"size": "x"}]}, {"productId": "2"}]}
    got = {r["product_id"]: r for r in records.shelf_items(answers(spark, [("007", "snacks", body), ("008", "snacks", {"data": []})], "store_id string, category string, body string")).collect()}
    assert (got["1"]["primary_category"], got["1"]["price_regular"], got["1"]["price_promo"], got["1"]["item_size"], got["1"]["store_id"]) == ("a", 3.5, 3.0, "12 oz", "007")
    assert got["2"]["price_regular"] is None and got["2"]["primary_category"] is None and len(got) == 2


def test_rival_items(spark):
    offers = [{"title": "t" * 600, "primary_offer": {"offer_price": 4.5}, "price": "$9"}, {"title": "text", "price": "$1,234.50", "price_per_unit": {"amount": "$0.18", "unit": "oz"}}, {"title": "none", "price": "n/a"},
              {"title": "free", "price": "0"}, {"title": "ad", "sponsored": True, "price": "$1"}, {"title": "gone", "out_of_stock": True, "price": "$1"}, {"title": "fallback", "primary_offer": {"offer_price": "x"}, "price": "2"}]
    rows = [(f"s{k}", "snacks", {"organic_results": offers if k == 0 else []}) for k in range(4)] + [("s4", "snacks", None)]
    schema = "store_id string, category string, body string"
    got = {r["product_name"]: (r["competitor_price"], r["price_per_unit"]) for r in records.rival_items(answers(spark, rows, schema)).collect()}
    assert got == {"t" * 500: (4.5, None), "text": (1234.5, 0.18), "fallback": (2.0, None)}
    with pytest.raises(records.Incomplete):
        records.rival_items(answers(spark, [*rows, ("s5", "snacks", None), ("s6", "snacks", None)], schema))


def test_filing_sections(spark):
    long = "word " * 60
    text = f"Table\nItem 1\n​\nITEM 1.\n{long}\n​\nsecond​ line\nItem 1A.\n{long}\nITEM 2.\nskip\nitem 7. \n{long}\nITEM 1.\nlater"
    got = {r["item"]: r["text"] for r in records.filing_sections(spark.createDataFrame([(1, text)], "id int, text string")).collect()}
    assert got["1"] == f"ITEM 1.\n\n{long.strip()}\n\nsecond line" and got["1A"].startswith("Item 1A.") and got["7"].endswith("later") and "skip" not in "".join(got.values())
    for bad in ("no items here", text.replace("item 7.", "item seven")):
        with pytest.raises(Exception, match="missing or too short"):
            records.filing_sections(spark.createDataFrame([(1, bad)], "id int, text string")).collect()


def test_series_record(spark):
    names = "id string, title string, units string, frequency string, seasonal_adjustment string, range string, last_updated string, category string, tags string, release string, notes string"
    x = spark.createDataFrame([("S", "t" * 300, "Index", "Monthly", None, "a to b", "now", "", "x, y", "r", None), ("T", *[None] * 10)], names)
    got = dict(records.series_record(x).collect())
    assert got["T"] is None and got["S"].split("\n")[0] == "Series ID: S" and "Seasonal adjustment: (none listed)" in got["S"] and "Category: (none listed)" in got["S"]


def test_manifest(spark, tmp_path):
    (tmp_path / "a b.md").write_text("# A\n\ntext")
    manifest = spark.createDataFrame([("d1", "a b.md"), ("d2", "lost.md")], "document_id string, filename string")
    got = {r["document_id"]: (r["text"], r["status"]) for r in sinks.manifest_files(spark, f"file://{tmp_path}", manifest).collect()}
    assert got == {"d1": ("# A\n\ntext", "OK"), "d2": (None, "PENDING")}
    assert {r["status"] for r in sinks.manifest_files(spark, f"file://{tmp_path}/none", manifest).collect()} == {"PENDING"}


def test_added_columns_and_conflicts(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([("a", 1)], "day string, n int"), path, "day")
    sinks.replace_partitions(spark.createDataFrame([("b", 2, "x")], "day string, n int, item string"), path, "day")
    assert sorted((r["day"], r["n"], r["item"]) for r in sinks.read(spark, path).collect()) == [("a", 1, None), ("b", 2, "x")]
    with pytest.raises(sinks.SchemaConflict):
        sinks.replace_partitions(spark.createDataFrame([("b", "2")], "day string, n string"), path, "day")
    assert sinks.read(spark, path).count() == 2 and not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_staged")]
    assert not sinks.partition_exists(spark, str(tmp_path / "none"), "day", "a")


def test_replace_evaluates_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([("a", k) for k in range(10)], "day string, n int").mapInArrow(count, "day string, n int")
    sinks.replace_partitions(df, str(tmp_path / "t"), "day", least_rows=5)
    assert seen.value == 10


def test_replace_keys_and_probes(spark, tmp_path):
    path = str(tmp_path / "k")
    sinks.replace_keys(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), path, "k")
    sinks.replace_keys(spark.createDataFrame([(2, "z", 1), (2, "w", 2)], "k int, v string, extra int"), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect())) == [(1, "x"), (2, "w"), (2, "z")]
    pulls = spark.createDataFrame([("a", date(2026, 8, 1)), ("b", date(2026, 7, 26)), ("c", date(2026, 7, 25))], "s string, at date")
    assert sorted(r["s"] for r in sinks.recent_keys(pulls, "at", ["s"], F.lit("2026-08-01").cast("date")).collect()) == ["a", "b"]
    status = lambda as_of: sinks.due(pulls, "at", as_of, 9, 16).first()["status"]
    assert [status(date(2026, 8, d)) for d in (10, 11, 17, 18)] == ["pass", "warn", "warn", "error"]
    assert sinks.due(pulls.limit(0), "at", date(2026, 8, 1), 9, 16).first()["status"] == "error"
    assert len(sinks.export(pulls)) == 3
    with pytest.raises(ValueError):
        sinks.export(pulls, 2)


def test_parameters_are_values(spark):
    spark.createDataFrame([(1, "it's; drop"), (2, "b")], "k int, v string").createOrReplaceTempView("asked_of")
    got = serving.asked(spark, "select k from asked_of where v = :v", 10, v="it's; drop")
    assert [r["k"] for r in got.collect()] == [1] and serving.asked(spark, "select k from asked_of", 1).count() == 1


def test_marts_are_stored_once(spark, tmp_path):
    calls = []

    @workspace.mart("k")
    def counted(session, sf):
        calls.append(sf)
        return session.range(5).withColumnRenamed("id", "k")

    assert counted(spark, "here").count() == counted(spark, "here").count() == 5 and calls == ["here"]
    assert counted(spark, "there").count() == 5 and calls == ["here", "there"]
    workspace.forget(spark, "here")
    assert counted(spark, "here").count() == 5 and calls == ["here", "there", "here"]
