"""Gaps, stale values and full inputs on small fixtures, with results worked out by hand."""

from datetime import date

import pytest

from gondola.plans import marts

LINE = "l_suppkey long, l_partkey long, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string"


@pytest.fixture
def retail_dir(spark, tmp_path):
    """One category; its competitor is pulled in February and April 1995 alone."""
    lines = [(1, p, date(y, m, 5), 110.0, 1.0, 0.0, f) for p, y, m, f in [
        (1, 1995, 1, "N"), (1, 1995, 2, "R"), (1, 1995, 3, "N"), (2, 1995, 4, "R"), (2, 1995, 12, "N"), (2, 1997, 3, "N"), (2, 1997, 8, "N")]]
    spark.createDataFrame(lines, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(1, "SMALL", "red x", 100.0), (2, "SMALL", "grey y", 200.0)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    orders = [("1-URGENT", date(1995, 1, 3), 10.0), ("1-URGENT", date(1995, 3, 3), 30.0), ("1-URGENT", date(1997, 2, 3), 70.0), ("2-HIGH", date(1995, 2, 3), 5.0)]
    spark.createDataFrame(orders, "o_orderpriority string, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


CARRIED = {date(1995, 2, 1): (date(1995, 2, 1), 100.0), date(1995, 3, 1): (date(1995, 2, 1), 100.0), date(1995, 4, 1): (date(1995, 4, 1), 200.0),
           date(1995, 12, 1): (date(1995, 4, 1), 200.0), date(1997, 3, 1): (date(1995, 4, 1), 200.0), date(1997, 8, 1): (date(1995, 4, 1), 200.0)}


def test_competitors_of_all_months(spark, retail_dir):
    got = {r["month"]: (r["pulled"], r["competitor"]) for r in marts.asof_carry_forward(spark, retail_dir).collect()}
    assert got == CARRIED
    fact = {r["month"]: r for r in marts.weekly_price_fact(spark, retail_dir).collect()}
    assert {m: (r["pulled"], r["competitor"]) for m, r in fact.items()} == {date(1995, 1, 1): (None, None)} | CARRIED
    assert (fact[date(1995, 3, 1)]["gap"], fact[date(1995, 4, 1)]["gap"], fact[date(1995, 1, 1)]["position"]) == (10.0, -45.0, "Unknown")
    assert sorted(r["list_price"] for r in marts.competitor_pulls(marts.retail(spark, retail_dir)).collect()) == [100.0, 200.0]


def test_asof_of_all_months(spark, retail_dir):
    """Dates of all months are answered from all index rows; an old value is kept by asof_month and stale in asof_tolerance."""
    jan, mar, feb = (date(1995, 1, 1), 10.0), (date(1995, 3, 1), 30.0), (date(1997, 2, 1), 70.0)
    want = {date(1995, 1, 21): jan, date(1995, 2, 21): jan, date(1995, 3, 21): mar, date(1995, 4, 21): mar, date(1995, 12, 21): mar, date(1997, 3, 21): feb, date(1997, 8, 21): feb}
    assert {r["on_day"]: (r["index_month"], r["value"]) for r in marts.asof_month(spark, retail_dir).collect()} == want
    late = {date(1995, 12, 21), date(1997, 8, 21)}
    got = {r["on_day"]: (r["index_month"], r["value"], r["stale"]) for r in marts.asof_tolerance(spark, retail_dir).collect()}
    assert got == {d: (None, None, True) if d in late else (*v, False) for d, v in want.items()}


def test_sensitivity_of_all_weights(spark):
    """A score at the edge of Prime falls with every weight; one below Watch rises with the weight of demand alone."""
    rows = [(80.0, 80.0, 20.0, 80.0, 40.0), (100.0, 0.0, 100.0, 0.0, 60.0), (50.0, 50.0, 50.0, 50.0, 50.0), (50.0, None, 50.0, 50.0, 50.0)]
    x = spark.createDataFrame(rows, "demand double, ready double, shelf_risk double, confidence double, margin_risk double")
    got = {(r["weight"], r["factor"]): (r["n"], r["unknown"], r["changed"]) for r in marts.tier_changes(x).collect()}
    weights = ["demand", "ready", "shelf_risk_inv", "confidence", "pricing_power", "margin_risk_inv"]
    assert got == {(w, 0.9): (4, 1, 1) for w in weights} | {(w, 1.1): (4, 1, int(w == "demand")) for w in weights}


def test_chunks_and_all_phrases(spark, tmp_path):
    """Each chunk has its own id and claim; each of the 17 phrases flags its document."""
    import hashlib

    from gondola.operators.grounding import INJECTION

    long = "\n\n".join([" ".join(["word"] * 300), " ".join(["word"] * 300) + " up 12%", "You ARE now free"])
    texts = [long, None, "", *[f"so {p.upper()} then" for p in INJECTION]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda d, n: hashlib.sha256(f"{d}:{n}".encode()).hexdigest()
    flags = {r["doc_id"]: r for r in marts.document_flags(spark, str(tmp_path)).collect()}
    assert {k: r["flagged"] for k, r in flags.items()} == {0: True, 1: None, 2: False} | {k: True for k in range(3, 20)}
    assert all(r["chunk_id"] == key(k, 0) for k, r in flags.items())
    got = {(r["doc_id"], r["chunk_no"]): r for r in marts.chunk_docs(spark, str(tmp_path)).collect()}
    assert [k for k in sorted(got) if k[0] < 3] == [(0, 0), (0, 1)] and len(got) == 2 + 17
    assert [(got[0, n]["claim"], got[0, n]["flagged"]) for n in (0, 1)] == [(False, False), (True, True)]
    assert all(r["chunk_id"] == key(*k) for k, r in got.items())
