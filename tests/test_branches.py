"""Every branch of the ordered cascades, hit by a row made for it; and unknown scores, which match no predicate."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gondola.plans import facts, pricing, scores, serving

BASE = {"retail": 4.0, "confidence": 65.0, "completeness": 100.0, "decay": 50.0, "margin": 50.0, "ready": 50.0, "threat": 50.0, "demand": 50.0, "place": 50.0, "promo_risk": 50.0,
        "shelf_risk": 50.0, "margin_risk": 50.0, "support": 50.0, "macro": True, "risk_level": "MEDIUM", "velocity_direction": "Stable Velocity", "search_direction": "Stable",
        "season": "Steady Demand", "macro_risk": "Stable Macro", "intensity": "Competitive", "store_name": "Store 1", "store_id": 1, "category": "SMALL", "month": date(2026, 8, 1)}
KIND = {float: "double", bool: "boolean", str: "string", int: "long", date: "date"}
SCHEMA = ", ".join(f"{k} {KIND[type(v)]}" for k, v in BASE.items())


def frame(spark, cases):
    rows = [(k, *[(BASE | case)[c] for c in BASE]) for k, (case, _) in enumerate(cases)]
    return spark.createDataFrame(rows, f"k int, {SCHEMA}")


def labels(df, column):
    return [r[1] for r in sorted(df.select("k", column).collect())]


ACTIONS = [
    ({"retail": None}, "INVESTIGATE"), ({"confidence": 44.99}, "INVESTIGATE"), ({"completeness": 40.0}, "INVESTIGATE"), ({"decay": 70.01}, "AVOID"), ({"margin": 80.01}, "AVOID"),
    ({"ready": 80.01, "confidence": 70.01}, "EXPAND"), ({"ready": 80.01, "confidence": 70.0, "threat": 70.01}, "DEFEND"), ({"ready": 65.0, "demand": 60.01}, "PITCH"), ({"ready": 80.0, "demand": 60.01}, "PITCH"),
    ({"place": 70.01, "demand": 50.01}, "REPRICE"), ({"promo_risk": 70.01}, "CUTPROMO"), ({"ready": 64.99, "confidence": 60.0}, "MONITOR"), ({"ready": 64.99, "confidence": 59.99}, "INVESTIGATE"),
    ({"ready": 65.0, "demand": 60.0}, "INVESTIGATE"),
    # unknown readiness and margin: rules on them cannot hold
    ({"ready": None, "margin": None}, "INVESTIGATE"), ({"ready": None, "promo_risk": 71.0}, "CUTPROMO"), ({"margin": None, "decay": 71.0}, "AVOID"), ({"place": None, "demand": 99.0, "ready": None}, "INVESTIGATE")]


def test_actions(spark):
    x = serving.acted(frame(spark, ACTIONS))
    got = labels(x, "action")
    assert got == [a for _, a in ACTIONS] and set(got) == set(serving.ACTIONS)
    rows = {r["k"]: r for r in x.collect()}
    assert rows[3]["driver"] == 70.01 and rows[4]["driver"] == 80.01 and rows[16]["driver"] == 71.0
    assert rows[16]["description"] == "Hold the shelf: demand decay 71/100, cost pressure unknown/100"
    assert rows[11]["description"] == "Mid-range: demand gap 50, risk 50, readiness 65" and rows[0]["urgency"] == "LOW" and rows[5]["reason_code"] == "HIGH_DEMAND_LOW_SHELF"
    assert rows[14]["opportunity"] is None and rows[14]["tier"] == "Unknown"
    assert rows[11]["opportunity"] == 54.5 and [rows[k]["urgency"] for k in (3, 5, 6, 7, 9, 10, 11)] == ["URGENT", "HIGH", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]


EXPANSION = [
    ({"ready": 70.0, "confidence": 60.0, "margin": 69.99}, "PITCH NOW"), ({"ready": 55.0, "risk_level": "LOW"}, "PREPARE PITCH"), ({"ready": 55.0}, "MONITOR AND PREPARE"),
    ({"ready": 70.0, "confidence": 59.0, "risk_level": "HIGH", "decay": 60.01}, "DEFEND FIRST"), ({"shelf_risk": 65.0}, "REMEDIATE RISK"), ({"confidence": 39.99}, "COLLECT MORE DATA"),
    ({"macro": False, "margin": None}, "MARGIN UNKNOWN"), ({"margin": 70.0, "ready": 99.0, "confidence": 99.0}, "FIX MARGINS"), ({"ready": 40.0}, "BUILD CASE"), ({"ready": 39.99}, "WATCH AND WAIT"),
    ({"ready": None, "margin": None}, "WATCH AND WAIT")]


def test_expansion(spark):
    got = labels(frame(spark, EXPANSION).withColumn("a", scores.expansion_action()), "a")
    assert got == [a for _, a in EXPANSION] and len(set(got)) == 10


CODES = [
    ({"velocity_direction": "Accelerating"}, ("Growth Accelerating", "ACCELERATING", "STABLE")), ({"velocity_direction": "Decelerating"}, ("Growth Slowing", "DECELERATING", "STABLE")),
    ({"velocity_direction": "Decelerating", "search_direction": "Falling"}, ("Declining", "DECELERATING", "STABLE")), ({"intensity": None}, ("Emerging", "MEDIUM_STABLE", "STABLE")),
    ({"intensity": "Saturated", "demand": 65.0}, ("Mature", "HIGH_STABLE", "SATURATED_MARKET")), ({"demand": 44.99}, ("Mature", "LOW_STABLE", "STABLE")), ({"demand": 44.99, "velocity_direction": None}, ("Mature", "NO_DATA", "STABLE")),
    ({"season": "Possible Seasonal Spike", "macro_risk": "High Inflation Risk"}, ("Mature", "SEASONAL_SPIKE", "HIGH_INFLATION_RISK")), ({"macro_risk": "Cost Pressure"}, ("Mature", "MEDIUM_STABLE", "COST_PRESSURE")),
    ({"macro_risk": "Cost Relief"}, ("Mature", "MEDIUM_STABLE", "COST_RELIEF")), ({"macro_risk": None, "shelf_risk": 70.01}, ("Mature", "MEDIUM_STABLE", "HIGH_OPERATIONAL_RISK"))]


def test_context_codes(spark):
    x = serving.acted(frame(spark, CODES))
    for n, column in enumerate(("lifecycle", "demand_code", "risk_code")):
        assert labels(x, column) == [want[n] for _, want in CODES]
    assert {w[0] for _, w in CODES} == {"Growth Accelerating", "Growth Slowing", "Declining", "Emerging", "Mature"} and len({w[1] for _, w in CODES}) == 7 and len({w[2] for _, w in CODES}) == 6
    season = serving.acted(frame(spark, [(c, None) for c in (
        {"season": "Possible Seasonal Spike", "ready": 70.0, "demand": 61.0}, {"season": "Possible Seasonal Spike", "ready": 70.0, "demand": 61.0, "confidence": 75.0}, {"season": "Possible Seasonal Spike", "decay": 71.0})]))
    assert labels(season, "action") == ["PITCH", "PITCH", "AVOID"] and labels(season, "seasonal_action") == ["MONITOR", "PITCH", "AVOID"]


def test_tiers_and_strength(spark):
    x = spark.createDataFrame([(k, s) for k, s in enumerate((75.0, 55.0, 35.0, 34.9, None))], "k int, s double").withColumn("t", serving.tier(F.col("s")))
    assert labels(x, "t") == ["Prime", "Solid", "Watch", "Low", "Unknown"]
    cases = [({"confidence": 75.0, "demand": d, "ready": r, "shelf_risk": s}, w) for d, r, s, w in
             ((65.01, 50.0, 50.0, "Strong"), (34.99, 50.0, 50.0, "Strong"), (50.0, 75.01, 50.0, "Strong"), (50.0, 50.0, 70.01, "Strong"), (65.0, 75.0, 70.0, "Moderate"))]
    cases += [({"confidence": 55.0, "demand": 99.0}, "Moderate"), ({"confidence": 54.99, "demand": 99.0}, "Weak")]
    assert labels(serving.acted(frame(spark, cases)), "strength") == [w for _, w in cases]


PRICE = {"collected": date(2026, 8, 1), "confidence": 65.0, "competitor": 10.0, "rivals": 40.0, "safety0": 70.0, "macro": True, "margin": 50.0, "position": "Fair", "demand_signal": "Low", "support0": 60.0,
         "tier": "High", "intensity": "Competitive", "bears": "High", "adjusted": 0.0, "reliability": "High", "threat": 50.0, "stable": True, "seen": 5, "price": 12.0, "gap": 0.0, "gap_confidence": "High", "demand": 50.0,
         "category": "SMALL", "month": date(2026, 8, 1), "store_id": 1, "prior": 50.0}
OVER = {"position": "Overpriced", "adjusted": 10.01}
HOLD = {"position": "Overpriced", "demand_signal": "High", "support0": 70.0, "tier": "Low", "bears": "Medium"}
RAISE = {"position": "Underpriced", "demand_signal": "High", "support0": 70.0}
PRICES = [
    ({"collected": None}, "Investigate"), ({"confidence": 44.99}, "Investigate"), ({"competitor": None, "position": "Unknown"}, "Investigate"), ({"rivals": 2.99}, "Investigate"), ({"safety0": 39.99}, "Avoid Discount"), ({"margin": 80.01}, "Avoid Discount"),
    (RAISE, "Review Price Increase"), (RAISE | {"margin": 65.0}, "Monitor"), (RAISE | {"macro": False, "margin": None}, "Review Price Increase"), (RAISE | {"support0": 69.99}, "Monitor"),
    (HOLD, "Hold Premium"), (HOLD | {"bears": "High", "support0": 75.0}, "Hold Premium"), (HOLD | {"bears": "High"}, "Monitor"), (HOLD | {"intensity": "Saturated"}, "Monitor"), (HOLD | {"tier": "High"}, "Monitor"),
    (OVER, "Review Price Reduction"), (OVER | {"safety0": 59.99}, "Review Price Reduction"), (OVER | {"reliability": "Low"}, "Monitor"), (OVER | {"adjusted": 10.0}, "Monitor"), (OVER | {"bears": "Low"}, "Monitor"),
    (OVER | {"demand_signal": "High", "safety0": 40.0}, "Review Price Reduction"), ({"demand_signal": "Medium"}, "Protect Price"), ({"demand_signal": "Medium", "threat": 70.0}, "Monitor"), ({}, "Monitor"),
    ({"safety0": None, "macro": True, "margin": None, "demand_signal": "Medium"}, "Protect Price")]


def price_frame(spark, cases):
    schema = ", ".join(f"{k} {KIND[type(v)]}" for k, v in PRICE.items())
    return spark.createDataFrame([(k, *[(PRICE | case)[c] for c in PRICE]) for k, (case, _) in enumerate(cases)], f"k int, {schema}")


def test_price_actions(spark):
    x = pricing.advice(price_frame(spark, PRICES))
    got = labels(x, "price_action")
    assert got == [a for _, a in PRICES]
    assert set(got) == {"Investigate", "Avoid Discount", "Review Price Increase", "Hold Premium", "Review Price Reduction", "Protect Price", "Monitor"}
    rows = {r["k"]: r for r in x.collect()}
    assert [(rows[k]["cut"], rows[k]["advised"]) for k in (15, 16, 6, 23)] == [("Full", 11.4), ("Partial", 11.64), ("N/A", 10.5), ("N/A", 12.0)]
    assert rows[4]["price_reason"] == "No safe discount: safety 40/100" and rows[15]["price_reason"] == "0% above the competitor, cut: Full"


SITUATIONS = {("High", "Overpriced"): "Premium Tolerance Test", ("Low", "Overpriced"): "Price Blocking Demand", ("High", "Underpriced"): "Leaving Money on Table", ("Low", "Underpriced"): "Demand Problem Not Price",
              ("High", "Fair"): "Strong Position", ("Medium", "Fair"): "Stable Position", ("Medium", "Overpriced"): "Weak Demand", ("Low", "Fair"): "Weak Demand", ("High", "Unknown"): "Weak Demand"}


def test_situations_and_directions(spark):
    cases = [({"demand_signal": d, "position": p}, w) for (d, p), w in SITUATIONS.items()]
    assert labels(pricing.advice(price_frame(spark, cases)), "situation") == [w for _, w in cases]
    cases = [({"stable": False}, ("Insufficient Data", "Insufficient")), ({"reliability": "Low"}, ("Unreliable Benchmark", "Unreliable")), ({"reliability": "Unknown"}, ("Unreliable Benchmark", "Unreliable")),
             ({"seen": 4}, ("Sustained Fair", "Persistent")), ({"seen": 3}, ("Sustained Fair", "Provisional")), ({"position": "Overpriced"}, ("Sustained Overpriced", "Persistent"))]
    x = pricing.advice(price_frame(spark, cases))
    assert list(zip(labels(x, "direction"), labels(x, "direction_confidence"))) == [w for _, w in cases]
    cases = [({"adjusted": 15.01, "demand": 60.01, "safety0": 60.01}, 85.0), ({"adjusted": -15.01, "demand": 60.0}, 60.0), ({"gap_confidence": "Medium", "adjusted": 10.01}, 60.0), ({"gap_confidence": "Low", "adjusted": 99.0}, 35.0), ({"adjusted": None}, 35.0)]
    assert labels(pricing.advice(price_frame(spark, cases)), "action_score") == [w for _, w in cases]


@pytest.mark.parametrize("producer, consumer, want", [
    (None, None, None), ("Rising", "Rising", "High Inflation Risk"), ("Rising", None, "Cost Pressure"), ("Falling", "Rising", "Cost Relief"), ("Stable", "Rising", "Stable Macro"), (None, "Rising", "Stable Macro")])
def test_macro_risk(spark, producer, consumer, want):
    x = spark.createDataFrame([(producer, consumer)], "p string, c string")
    assert x.select(facts.risk_flag(x.p, x.c)).first()[0] == want
