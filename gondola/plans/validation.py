"""How far signals can be relied on: persistence against a permutation null, zero changes, reproduction, sensitivity, rules, splits, forecasts, models."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.config import T
from gondola.functions.exprs import clamp, first_match, half_up
from gondola.operators.forecast import lag_forecast
from gondola.operators.models import audited, direction_scores, fold_scores, importance
from gondola.plans.facts import KEYS, prices
from gondola.plans.pricing import pricing
from gondola.plans.registry import cl, query, r, view
from gondola.plans.scores import demand
from gondola.plans.serving import ACTIONS, opportunity_parts, queue
from gondola.sources.tables import interest
from gondola.sources.workspace import stored

#: Permutations of a panel, months ahead, and the change of a gap (percentage points) that still counts as the same.
PERMUTATIONS = 500
HORIZONS = (1, 2, 3)
STILL = 0.08 + 1e-9
SEED = 20260830
#: Natural breaks of the size of gaps.
SMALL, MODERATE = 33.265, 105.515
MEASURES = {"direction": "position", "magnitude": "gap", "action": "direction"}

_BAND = f"CASE WHEN gap IS NULL THEN 'none' WHEN abs(gap) <= {SMALL} THEN 'Small' WHEN abs(gap) <= {MODERATE} THEN 'Moderate' ELSE 'Large' END"


def band() -> Column:
    size = F.abs("gap")
    return first_match([(size.isNull(), "none"), (size <= SMALL, "Small"), (size <= MODERATE, "Moderate")], "Large")


view("v_panel", f"""SELECT month, store_id, category, gap_direction AS position, gap, dated AS reliability, {_BAND} AS band, dense_rank() OVER (ORDER BY month) AS k,
  CASE WHEN NOT stable THEN 'Insufficient Data' WHEN dated IN ('Low', 'Unknown') THEN 'Unreliable Benchmark' ELSE 'Sustained ' || position END AS direction
  FROM (SELECT *, CASE WHEN reliability NOT IN ('Unknown', 'Low') AND stale > {T.stale_days} THEN 'Low' ELSE reliability END AS dated FROM v_price)""")


def panel(spark, sf) -> DataFrame:
    """Each price fact's direction, gap, advice and reliability (here with the staleness of the competitor's price)."""
    c = F.col
    dated = F.when(~c("reliability").isin("Unknown", "Low") & (c("stale") > T.stale_days), "Low").otherwise(c("reliability"))
    x = prices(spark, sf).withColumn("dated", dated)
    advice = F.when(~c("stable"), "Insufficient Data").when(c("dated").isin("Low", "Unknown"), "Unreliable Benchmark").otherwise(F.concat(F.lit("Sustained "), "position"))
    return x.select(*KEYS, c("gap_direction").alias("position"), "gap", c("dated").alias("reliability"), band().alias("band"), advice.alias("direction"))


def _transitions(draws: int):
    """Of one entity's panel: stable and valid pairs by draw (-1: as observed), stratum, measure and horizon."""

    def count(key, panel):
        panel = panel.sort_values("k")
        k, strata = panel["k"].to_numpy(), panel["stratum"].to_numpy()
        rng = np.random.default_rng([SEED, zlib.crc32("/".join(map(str, key)).encode())])
        found = []
        for measure, column in MEASURES.items():
            if measure == "magnitude":
                values = panel[column].to_numpy(float, na_value=np.nan)
            else:  # 0: a known lack of knowledge, which is permuted but never counted
                names = ["Unknown", *sorted(set(panel[column].dropna()) - {"Unknown"})]
                values = panel[column].map({x: float(i) for i, x in enumerate(names)}).to_numpy(float)
            at = np.flatnonzero(~np.isnan(values))
            rows = np.tile(values, (draws + 1, 1))
            rows[1:, at] = values[rng.permuted(np.tile(at, (draws, 1)), axis=1)]
            for n in HORIZONS:
                j = np.minimum(np.searchsorted(k, k + n), len(k) - 1)
                i = np.flatnonzero(k[j] == k + n)
                x, y = rows[:, i], rows[:, j[i]]
                valid = ~np.isnan(x) & ~np.isnan(y)
                if measure != "magnitude":
                    valid &= (x != 0) & (y != 0)
                stable = valid & (np.abs(x - y) <= (STILL if measure == "magnitude" else 0))
                for s in sorted(set(strata[i])):
                    own = strata[i] == s
                    found.append(pd.DataFrame({"stratum": s, "measure": measure, "horizon": f"T+{n}", "draw": np.arange(-1, draws), "stable": stable[:, own].sum(1), "valid": valid[:, own].sum(1)}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in ("stratum", "measure", "horizon", "draw", "stable", "valid")})

    return count


def persistence(facts: DataFrame, stratum: Column, draws: int = PERMUTATIONS, overall: bool = False) -> DataFrame:
    """How often direction, magnitude and action hold 1 to 3 months on, by stratum, against panels permuted within each store and category.

    A permutation leaves an entity's absent months absent and the strata where they are.  Seeded by entity, so that reruns agree.
    by_chance, p5 and p95 are of the permuted panels.  overall adds the stratum ALL.
    Cost: an entity's months times `draws` in a Python worker; months are bounded, entities are dealt.
    """
    c = F.col
    # one row a month is ranked
    months = facts.select("month").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("month")))
    rows = facts.select(*KEYS, stratum.alias("stratum"), *MEASURES.values()).join(F.broadcast(months), "month")
    counts = rows.groupBy("store_id", "category").applyInPandas(_transitions(draws), "stratum string, measure string, horizon string, draw int, stable long, valid long")
    keys = ["stratum", "measure", "horizon"]
    sums = counts.groupBy(*keys, "draw").agg(F.sum("valid").alias("valid"), F.sum("stable").alias("stable"))
    if overall:  # one row a stratum, measure, horizon and draw
        sums = stored(sums, "persistence")
        every = sums.groupBy("measure", "horizon", "draw").agg(F.sum("valid").alias("valid"), F.sum("stable").alias("stable"))
        sums = sums.unionByName(every.withColumn("stratum", F.lit("ALL")))
    rates = sums.select(*keys, "draw", c("valid").alias("n"), F.try_divide(c("stable").cast("double"), c("valid").cast("double")).alias("rate"))
    seen = rates.where("draw = -1 and n > 0").drop("draw")
    dealt = rates.where("draw >= 0").select(*keys, c("rate").alias("chance"))
    tails = F.percentile("chance", F.array(F.lit(0.05), F.lit(0.95)))
    x = seen.join(dealt, keys).groupBy(*keys, "n", "rate").agg(F.avg("chance").alias("m"), tails.alias("t"), ((F.count_if(c("chance") >= c("rate")) + 1) / F.lit(float(draws + 1))).alias("p_value"))
    pct = lambda e: half_up(e * 100, 4)
    return x.select(*keys, "n", pct(c("rate")).alias("persisted"), pct(c("m")).alias("by_chance"), pct(F.get("t", F.lit(0))).alias("p5"), pct(F.get("t", F.lit(1))).alias("p95"), pct(c("rate") - c("m")).alias("lift"), "p_value")


@query(None)
def persistence_null(spark, sf):
    """By reliability, and over all."""
    return persistence(panel(spark, sf), F.col("reliability"), overall=True)


@query(None)
def persistence_by_magnitude(spark, sf):
    """Strata of like gaps: a large gap persists more easily than a small one."""
    return persistence(panel(spark, sf), F.col("band"))


_HELD = {"direction": "x.position <> 'Unknown' AND y.position <> 'Unknown'", "magnitude": "x.gap IS NOT NULL AND y.gap IS NOT NULL", "action": "x.direction <> 'Unknown' AND y.direction <> 'Unknown'"}
_SAME = {"direction": "x.position = y.position", "magnitude": f"abs(x.gap - y.gap) <= {STILL:.12f}", "action": "x.direction = y.direction"}


@query(" UNION ALL ".join(f"""SELECT '{s}' AS strata, x.{s} AS stratum, '{m}' AS measure, 'T+' || n::VARCHAR AS horizon, count(*) AS n, {r(f'count_if({_SAME[m]}) * 100.0::DOUBLE / count(*)', 4)} AS persisted FROM v_panel x, range(1, 4) h(n), v_panel y
  WHERE x.store_id = y.store_id AND x.category = y.category AND y.k = x.k + n AND {_HELD[m]} GROUP BY ALL""" for s in ("reliability", "band") for m in MEASURES))
def persistence_observed(spark, sf):
    """The observed rates of persistence_null and persistence_by_magnitude, without the null: leads of each panel row by months."""
    c = F.col
    months = prices(spark, sf).select("month").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("month")))  # one row a month
    x = panel(spark, sf).join(F.broadcast(months), "month")
    w = Window.partitionBy("store_id", "category").orderBy("k")
    what = F.struct("k", "position", "gap", "direction")
    x = x.withColumns({f"y{j}": F.lead(what, j).over(w) for j in HORIZONS})  # the row n months on is at most n rows on
    pairs = x.withColumn("y", F.explode(F.array(*[f"y{j}" for j in HORIZONS]))).where(c("y").isNotNull()).withColumn("n", c("y.k") - c("k")).where(c("n") <= max(HORIZONS))
    held = {"direction": (c("position") != "Unknown") & (c("y.position") != "Unknown"), "magnitude": c("gap").isNotNull() & c("y.gap").isNotNull(), "action": (c("direction") != "Unknown") & (c("y.direction") != "Unknown")}
    same = {"direction": c("position") == c("y.position"), "magnitude": F.abs(c("gap") - c("y.gap")) <= STILL, "action": c("direction") == c("y.direction")}
    tests = F.array(*[F.struct(F.lit(m).alias("measure"), F.coalesce(held[m], F.lit(False)).alias("held"), same[m].alias("same")) for m in MEASURES])
    strata = F.array(*[F.struct(F.lit(s).alias("strata"), c(s).alias("stratum")) for s in ("reliability", "band")])
    long = pairs.select("n", F.explode(tests).alias("t"), strata.alias("s")).where("t.held").select("n", "t.measure", "t.same", F.explode("s").alias("s"))
    return long.groupBy("s.strata", "s.stratum", "measure", F.concat(F.lit("T+"), c("n").cast("string")).alias("horizon")).agg(
        F.count("*").alias("n"), half_up(F.count_if("same") * 100.0 / F.count("*"), 4).alias("persisted"))


@query(f"SELECT category, count(*) AS n, {r('avg(CASE WHEN position = nxt THEN 1.0::DOUBLE ELSE 0.0 END) * 100')} AS persistence FROM (SELECT category, position, lead(position) OVER (PARTITION BY store_id, category ORDER BY month) AS nxt FROM v_fact WHERE position <> 'Unknown') WHERE nxt IS NOT NULL GROUP BY category")
def transition_persistence(spark, sf):
    x = prices(spark, sf).where("position <> 'Unknown'")
    t = x.withColumn("nxt", F.lead("position").over(Window.partitionBy("store_id", "category").orderBy("month"))).where("nxt is not null")
    return t.groupBy("category").agg(F.count("*").alias("n"), half_up(F.avg((F.col("position") == F.col("nxt")).cast("double")) * 100).alias("persistence"))


@query("""SELECT category, count(*) AS n, coalesce(count_if(abs(gap - gap1) < 0.005), 0) AS still, coalesce(count_if(pulled = pulled1), 0) AS carried, coalesce(count_if(abs(gap - gap1) < 0.005 AND pulled = pulled1), 0) AS still_and_carried, coalesce(count_if(abs(price - price1) < 0.005), 0) AS same_price, coalesce(count_if(abs(competitor - competitor1) < 0.005), 0) AS same_competitor
FROM (SELECT *, lag(pulled) OVER w AS pulled1, lag(price) OVER w AS price1, lag(gap) OVER w AS gap1, lag(competitor) OVER w AS competitor1 FROM v_price WINDOW w AS (PARTITION BY store_id, category ORDER BY month)) GROUP BY ALL""")
def zero_change(spark, sf):
    """Gaps that did not move, and how many of them rest on a competitor's price carried forward."""
    c = F.col
    v = Window.partitionBy("store_id", "category").orderBy("month")
    x = prices(spark, sf).withColumns({f"{k}1": F.lag(k).over(v) for k in ("pulled", "price", "gap", "competitor")})
    still, carried = F.abs(c("gap") - c("gap1")) < 0.005, c("pulled") == c("pulled1")
    return x.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if(still).alias("still"), F.count_if(carried).alias("carried"), F.count_if(still & carried).alias("still_and_carried"),
        F.count_if(F.abs(c("price") - c("price1")) < 0.005).alias("same_price"), F.count_if(F.abs(c("competitor") - c("competitor1")) < 0.005).alias("same_competitor"))


@query("""SELECT 'direction of the gap' AS what, count(*) AS n, count_if(again = gap_direction) AS matched FROM (SELECT *, CASE WHEN gap IS NULL THEN 'Unknown' WHEN price > competitor THEN 'Overpriced' ELSE 'Underpriced' END AS again FROM v_price)
UNION ALL SELECT 'position', count(*), count_if(again = position) FROM (SELECT *, CASE WHEN gap IS NULL THEN 'Unknown' WHEN gap > band THEN 'Overpriced' WHEN gap < -band THEN 'Underpriced' ELSE 'Fair' END AS again FROM v_price)
UNION ALL SELECT 'advice', count(*), count_if(p.direction = q.direction) FROM v_panel p JOIN v_anchor ON p.month = anchor JOIN (SELECT month, store_id, category, direction FROM v_pricing) q ON p.month = q.month AND p.store_id = q.store_id AND p.category = q.category""")
def reproduction(spark, sf):
    """Labels worked out again from what is stored beside them, against the stored ones."""
    c = F.col
    x = prices(spark, sf)
    direction = first_match([(c("gap").isNull(), "Unknown"), (c("price") > c("competitor"), "Overpriced")], "Underpriced")
    position = first_match([(c("gap").isNull(), "Unknown"), (c("gap") > c("band"), "Overpriced"), (c("gap") < -c("band"), "Underpriced")], "Fair")
    one = lambda df, what, again, label: df.agg(F.count("*").alias("n"), F.count_if(again == label).alias("matched")).select(F.lit(what).alias("what"), "n", "matched")
    intel = pricing(spark, sf).where(c("collected") == c("month")).select(*KEYS, c("direction").alias("stored"))
    both = panel(spark, sf).join(intel, KEYS)
    return one(x, "direction of the gap", direction, c("gap_direction")).unionByName(one(x, "position", position, c("position"))).unionByName(one(both, "advice", c("direction"), c("stored")))


# --- sensitivity ----------------------------------------------------------------------------------

_PARTS = {"demand": "demand", "ready": "ready", "shelf_risk_inv": "(100 - shelf_risk)", "confidence": "confidence", "pricing_power": "coalesce(support, 50)", "margin_risk_inv": "(100 - margin_risk)"}
_TIER_NO = lambda s: f"CASE WHEN {s} >= {T.tier_prime} THEN 3 WHEN {s} >= {T.tier_solid} THEN 2 WHEN {s} >= {T.tier_watch} THEN 1 WHEN {s} IS NOT NULL THEN 0 END"


@query(f"""SELECT weight, factor, count(*) AS n, count_if(was IS NULL) AS unknown, coalesce(count_if({_TIER_NO('was')} <> {_TIER_NO('moved')}), 0) AS changed
FROM (SELECT weight, factor, {r(cl('base'), 6)} AS was, {r(cl('base + (factor - 1) * share * part'), 6)} AS moved FROM (SELECT *, {' + '.join(f'{T.opportunity[k]}::DOUBLE * {p}' for k, p in _PARTS.items())} AS base, CASE weight {' '.join(f"WHEN '{k}' THEN {p}" for k, p in _PARTS.items())} END AS part
  FROM v_queue, (VALUES {', '.join(f"('{k}', {w}::DOUBLE)" for k, w in T.opportunity.items())}) w(weight, share), (VALUES (0.9::DOUBLE), (1.1::DOUBLE)) f(factor))) GROUP BY ALL""")
def sensitivity_tiers(spark, sf):
    """Signals that change tier when one weight of the opportunity score is 10 % lower or higher: 6 weights x 2 factors."""
    return tier_changes(queue(spark, sf))


def tier_changes(x: DataFrame, factors: tuple[float, ...] = (0.9, 1.1)) -> DataFrame:
    """weight, factor, n, unknown (signals without a score, which have no tier) and changed."""
    c = F.col
    if "support" not in x.columns:
        x = x.withColumn("support", F.lit(None).cast("double"))
    parts, weights = opportunity_parts(), T.opportunity
    # rounded far below any step of a score, so that the order of additions cannot move a tier
    base = sum(w * parts[k] for k, w in weights.items())
    tier = lambda s: first_match([(s.isNull(), None), (s >= T.tier_prime, 3), (s >= T.tier_solid, 2), (s >= T.tier_watch, 1)], 0)
    runs = F.array(*[F.struct(F.lit(k).alias("weight"), F.lit(f).alias("factor"), ((f - 1) * w * parts[k]).alias("step")) for k, w in weights.items() for f in factors])
    t = x.select(base.alias("base"), F.explode(runs).alias("run")).select("base", "run.*").withColumns({"was": half_up(clamp(c("base")), 6), "is": half_up(clamp(c("base") + c("step")), 6)})
    return t.groupBy("weight", "factor").agg(F.count("*").alias("n"), F.count_if(c("was").isNull()).alias("unknown"), F.count_if(tier(c("was")) != tier(c("is"))).alias("changed"))


# --- rules ----------------------------------------------------------------------------------------

#: Rules by name: where each applies, what must hold there, and the share of rows that must keep it.
RULES = {
    "scores_in_range": ("true", "demand BETWEEN 0 AND 100 AND shelf_risk BETWEEN 0 AND 100 AND confidence BETWEEN 0 AND 100", 100),
    "unknown_macro_unknown_ready": ("cpi IS NULL", "ready IS NULL", 100), "urgent_is_avoid": ("true", "(urgency = 'URGENT') = (action = 'AVOID')", 100),
    "weak_data_investigated": ("confidence < 45", "action = 'INVESTIGATE'", 95), "driver_known": ("true", "driver IS NOT NULL", 100),
    "pitch_in_window": ("action = 'PITCH'", "demand > 60 AND ready BETWEEN 65 AND 80", 95), "monitor_is_confident": ("action = 'MONITOR'", "confidence >= 60", 95),
    "cutpromo_reason": ("action = 'CUTPROMO'", "reason_code = 'PROMO_RISK_MARGIN_PRESSURE'", 95), "defend_reason": ("action = 'DEFEND'", "reason_code = 'COMPETITOR_THREAT_HIGH'", 95),
    "strong_demand_is_pitched": ("demand > 60 AND ready > 65", "action IN ('PITCH', 'EXPAND')", 95), "pressed_margin_is_protected": ("margin > 50 AND promo_risk > 50", "action IN ('CUTPROMO', 'AVOID')", 80)}


@query(" UNION ALL ".join(f"SELECT '{name}' AS rule, n, held, CASE WHEN n = 0 THEN 100.0::DOUBLE ELSE {r('held * 100.0::DOUBLE / n', 1)} END AS pct, n = 0 OR held * 100.0 / n >= {target} AS passed FROM (SELECT count(*) AS n, coalesce(sum(CASE WHEN {rule} THEN 1 ELSE 0 END), 0)::BIGINT AS held FROM v_queue WHERE {where})" for name, (where, rule, target) in RULES.items()))
def rule_consistency(spark, sf):
    """Of the signals that each rule is about, how many keep it; an unknown answer is a breach.  One pass for all rules."""
    return consistent(queue(spark, sf), RULES)


def consistent(x: DataFrame, rules: dict[str, tuple[str, str, float]]) -> DataFrame:
    ones = {name: (F.expr(where), F.expr(rule)) for name, (where, rule, _) in rules.items()}
    sums = x.agg(*[F.struct(F.lit(name).alias("rule"), F.count_if(where).alias("n"), F.count_if(where & F.coalesce(rule, F.lit(False))).alias("held"), F.lit(float(rules[name][2])).alias("target")).alias(name) for name, (where, rule) in ones.items()])
    found = sums.select(F.explode(F.array(*[F.col(n) for n in rules])).alias("s")).select("s.*")
    pct = F.when(F.col("n") == 0, 100.0).otherwise(F.try_divide(F.col("held") * 100.0, F.col("n")))
    return found.select("rule", "n", "held", half_up(pct, 1).alias("pct"), (pct >= F.col("target")).alias("passed"))


@query("SELECT store_id, " + ", ".join(f"sum(CASE WHEN action = '{a}' THEN 1 ELSE 0 END)::BIGINT AS {a.lower()}" for a in ACTIONS) + " FROM v_queue GROUP BY store_id")
def action_heatmap(spark, sf):
    """Stores x actions; the columns are fixed, so no pass looks for them first."""
    x = queue(spark, sf).groupBy("store_id").pivot("action", list(ACTIONS)).agg(F.count(F.lit(1)))
    return x.select("store_id", *[F.coalesce(F.col(a), F.lit(0)).alias(a.lower()) for a in ACTIONS])


# --- splits, forecasts, models --------------------------------------------------------------------


@query("""SELECT train, store_id % 5 = 0 AS held_out_store, count(*) AS n, min(month) AS first_month, max(month) AS last_month FROM v_fact JOIN (SELECT month, k <= 0.8 * max(k) OVER () AS train FROM (SELECT month, dense_rank() OVER (ORDER BY month) AS k FROM (SELECT DISTINCT month FROM v_fact))) USING (month) GROUP BY ALL""")
def temporal_split(spark, sf):
    x = split(prices(spark, sf)).withColumn("held_out_store", F.col("store_id") % 5 == 0)
    return x.groupBy("train", "held_out_store").agg(F.count("*").alias("n"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


def split(facts: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds train: whether a row's month is among the first `share` of the distinct months (one row a month is ranked)."""
    months = facts.select("month").distinct()
    ranked = months.withColumns({"k": F.dense_rank().over(Window.orderBy("month")), "all": F.count("*").over(Window.partitionBy(F.lit(0)))})
    return facts.join(F.broadcast(ranked.select("month", (F.col("k") <= share * F.col("all")).alias("train"))), "month")


#: The models by how easily they are explained.
MODELS = {"naive": 10, "moving": 9, "linear": 8}
view("v_forecast", """SELECT category, interest, naive, moving, slope * x + start AS linear FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY day DESC) AS k, row_number() OVER (PARTITION BY category ORDER BY day) AS x FROM v_interest)
  JOIN (SELECT category, arg_max(interest, day) FILTER (k > 4) AS naive, avg(interest) FILTER (k BETWEEN 5 AND 8) AS moving, regr_slope(interest, x) FILTER (k > 4) AS slope, regr_intercept(interest, x) FILTER (k > 4) AS start
    FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY day DESC) AS k, row_number() OVER (PARTITION BY category ORDER BY day) AS x FROM v_interest) GROUP BY category) USING (category) WHERE k <= 4""")
_ERRORS = {"mape": "avg(abs(interest - {m}) / nullif(abs(interest), 0)) * 100", "mae": "avg(abs(interest - {m}))", "rmse": "sqrt(avg((interest - {m}) * (interest - {m})))"}


def forecasts(x: DataFrame) -> DataFrame:
    """The last four values of each category with what the earlier ones foretell: the last, the mean of four, a line."""
    c, w = F.col, Window.partitionBy("category")
    k = x.withColumns({"k": F.row_number().over(w.orderBy(F.desc("day"))), "x": F.row_number().over(w.orderBy("day"))})
    old = k.where("k > 4").groupBy("category").agg(
        F.max_by("interest", "day").alias("naive"), F.avg(F.when(c("k").between(5, 8), c("interest"))).alias("moving"), F.regr_slope("interest", "x").alias("s"), F.regr_intercept("interest", "x").alias("i"))
    return k.where("k <= 4").join(F.broadcast(old), "category").withColumn("linear", c("s") * c("x") + c("i"))  # one row a category


def errors(f: DataFrame, by: list[str]) -> DataFrame:
    """MAPE (zeros left out), MAE and RMSE of each model."""
    i = F.col("interest")
    away = {m: i - F.col(m) for m in MODELS}
    kinds = {"mape": lambda d: F.avg(F.try_divide(F.abs(d), F.abs(i))) * 100, "mae": lambda d: F.avg(F.abs(d)), "rmse": lambda d: F.sqrt(F.avg(d * d))}
    return f.groupBy(*by).agg(*[e(d).alias(f"{n}_{m}") for n, e in kinds.items() for m, d in away.items()])


@query(f"SELECT category, {', '.join(r(e.format(m=m)) + f' AS {n}_{m}' for n, e in _ERRORS.items() for m in MODELS)} FROM v_forecast GROUP BY category")
def forecast_baselines(spark, sf):
    found = errors(forecasts(interest(spark, sf)), ["category"])
    return found.select("category", *[half_up(F.col(k)).alias(k) for k in found.columns[1:]])


view("v_mape", " UNION ALL ".join(f"SELECT '{m}' AS model, {e}::DOUBLE AS plain, category, {_ERRORS['mape'].format(m=m)} AS mape, {_ERRORS['mape'].format(m='naive')} AS base FROM v_forecast GROUP BY category" for m, e in MODELS.items()))


@query(f"""SELECT model, {r('c1')} AS accuracy, {r('c2')} AS beats_naive, {r('c3')} AS stability, plain AS interpretable, {r('c1 * 0.4 + c2 * 0.2 + c3 * 0.2 + plain * 0.2')} AS score, CAST(row_number() OVER (ORDER BY {r('c1 * 0.4 + c2 * 0.2 + c3 * 0.2 + plain * 0.2', 6)} DESC, model) AS BIGINT) AS place
FROM (SELECT *, 10 * (1 - coalesce((m - min(m) OVER ()) / nullif(max(m) OVER () - min(m) OVER (), 0), 0)) AS c1, better * 10.0::DOUBLE / n AS c2, greatest(0.0::DOUBLE, 10 - coalesce(s / nullif(max(s) OVER (), 0), 0) * 10) AS c3
  FROM (SELECT model, plain, avg(mape) AS m, stddev_samp(mape) AS s, count(*) AS n, count_if(mape < base) AS better FROM v_mape GROUP BY ALL))""")
def forecast_selection(spark, sf):
    """The models by accuracy (0.4), categories in which they beat the last value, stability and simplicity (0.2 each); place 1 wins."""
    c = F.col
    per = errors(forecasts(interest(spark, sf)), ["category"])
    long = per.select("category", c("mape_naive").alias("base"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(e)).alias("plain"), c(f"mape_{m}").alias("mape")) for m, e in MODELS.items()])).alias("x")).select("base", "x.*")
    s = long.groupBy("model", "plain").agg(F.avg("mape").alias("m"), F.stddev_samp("mape").alias("s"), F.count("*").alias("n"), F.count_if(c("mape") < c("base")).alias("better"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # three rows
    low, high, wide = F.min("m").over(every), F.max("m").over(every), F.max("s").over(every)
    s = s.withColumns({
        "c1": 10 * (1 - F.coalesce(F.try_divide(c("m") - low, high - low), F.lit(0.0))), "c2": c("better") * 10.0 / c("n"),
        "c3": F.greatest(F.lit(0.0), 10 - F.coalesce(F.try_divide(c("s"), wide), F.lit(0.0)) * 10)})
    score = c("c1") * 0.4 + c("c2") * 0.2 + c("c3") * 0.2 + c("plain") * 0.2
    return s.select(
        "model", half_up(c("c1")).alias("accuracy"), half_up(c("c2")).alias("beats_naive"), half_up(c("c3")).alias("stability"), c("plain").alias("interpretable"), half_up(score).alias("score"),
        F.row_number().over(Window.orderBy(half_up(score, 6).desc(), "model")).cast("long").alias("place"))


STEPS = 8
view("v_series", f"""SELECT category, day, interest AS truth, k, coalesce(interest, median(interest) FILTER (k > {STEPS}) OVER (PARTITION BY category)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY day DESC) AS k FROM v_interest)""")
view("v_equations", f"""SELECT *, (b1 * s22 - b2 * s12) / nullif(s11 * s22 - s12 * s12, 0) AS c1, (b2 * s11 - b1 * s12) / nullif(s11 * s22 - s12 * s12, 0) AS c2 FROM (SELECT category, covar_pop(l1, l1) AS s11, covar_pop(l1, l4) AS s12, covar_pop(l4, l4) AS s22, covar_pop(l1, v) AS b1, covar_pop(l4, v) AS b2, avg(v) AS m, avg(l1) AS m1, avg(l4) AS m4
  FROM (SELECT *, lag(v) OVER w AS l1, lag(v, 4) OVER w AS l4 FROM v_series WHERE k > {STEPS} WINDOW w AS (PARTITION BY category ORDER BY day)) WHERE l4 IS NOT NULL GROUP BY category)""")
view("v_folded", f"""WITH RECURSIVE f AS (SELECT category, 0 AS step, NULL::DOUBLE AS p, max(v) FILTER (k = {STEPS + 1}) AS h1, max(v) FILTER (k = {STEPS + 2}) AS h2, max(v) FILTER (k = {STEPS + 3}) AS h3, max(v) FILTER (k = {STEPS + 4}) AS h4 FROM v_series GROUP BY category
  UNION ALL SELECT category, step + 1, q, q, h1, h2, h3 FROM (SELECT f.*, greatest(0.0::DOUBLE, m - c1 * m1 - c2 * m4 + c1 * h1 + c2 * h4) AS q FROM f JOIN v_equations USING (category) WHERE step < {STEPS})) SELECT category, {STEPS} + 1 - step AS k, p FROM f WHERE step > 0""")


@query(f"SELECT category, count(*) AS n, {r('avg(abs(truth - p) / nullif(abs(truth), 0)) * 100')} AS mape, {r('avg(abs(truth - p))')} AS mae, {r('sqrt(avg((truth - p) * (truth - p)))')} AS rmse FROM v_series JOIN v_folded USING (category, k) WHERE truth IS NOT NULL GROUP BY category")
def lag_forecasts(spark, sf):
    """Errors of a recursive forecast from the lags 1 and 4, eight days ahead; gaps are filled with medians of the training part alone."""
    f = lag_forecast(interest(spark, sf), "category", "day", "interest", (1, 4), STEPS).where("interest is not null")
    away = F.col("interest") - F.col("forecast")
    return f.groupBy("category").agg(
        F.count("*").alias("n"), half_up(F.avg(F.try_divide(F.abs(away), F.abs("interest"))) * 100).alias("mape"), half_up(F.avg(F.abs(away))).alias("mae"), half_up(F.sqrt(F.avg(away * away))).alias("rmse"))


_FEATURES = ["gap", "moved", "amount", "run", "band"]


def widening(spark, sf) -> DataFrame:
    """Price facts with what their gap did next (label: it rose) and what was known before."""
    c = F.col
    v = Window.partitionBy("store_id", "category").orderBy("month")
    x = split(prices(spark, sf)).withColumns({
        "label": (F.lead("gap").over(v) > c("gap")).cast("double"), "moved": F.coalesce(c("gap") - c("prev_gap"), F.lit(0.0)), "amount": c("products").cast("double"), "run": c("run_length").cast("double")})
    return x.where("label is not null and gap is not null").select(*KEYS, "train", "label", *_FEATURES)


@query(None)
def direction_models(spark, sf):
    """Will the gap widen?  Models learn from the first months and are judged on the last, beside a shuffled target."""
    return direction_scores(widening(spark, sf), _FEATURES, KEYS)


@query(None)
def direction_folds(spark, sf):
    return fold_scores(widening(spark, sf), _FEATURES, KEYS)


@query(None)
def direction_importance(spark, sf):
    return importance(widening(spark, sf), _FEATURES)


#: What a demand score is made of, and what lies before it.
AUDIT = {
    "components": ["momentum", "shelf_gap", "phantom", "intent", "retail", "n_products", "ppi_score", "cpi_score", "category"],
    "masked": ["retail", "n_products", "ppi_score", "cpi_score", "category"]}


@query(None)
def leakage_audit(spark, sf):
    """Is the demand tier foretold by parts of its own formula?  The same models with these and without, on stores held out."""
    x = demand(spark, sf).withColumn("label", (F.col("demand") >= T.demand_high).cast("double"))
    return audited(x, AUDIT, "store_id", KEYS, folds=2, trees=8)


#: What is known in the month before a price moves.
MOVES = {"signals": ["gap", "band", "products", "promo_share", "own_brand", "category"], "history": ["gap", "band", "products", "promo_share", "own_brand", "category", "prev_gap", "gap_change", "run_length", "volatility_so_far"]}
MOVE = 3.0


def moves(spark, sf) -> DataFrame:
    """Price facts with label: does the price move by three per cent or more in the next month?  Deviations are of what was seen so far."""
    v = Window.partitionBy("store_id", "category").orderBy("month")
    x = prices(spark, sf).withColumns({"next": F.lead("price").over(v), "volatility_so_far": F.stddev_samp("gap").over(v.rowsBetween(Window.unboundedPreceding, 0))})
    return x.where("next is not null and price > 0").withColumn("label", (F.abs(F.col("next") / F.col("price") - 1) * 100 >= MOVE).cast("double"))


@query(None)
def price_movement_backtest(spark, sf):
    """Can the signals of a month tell that a price moves in the next one, in stores that the model has not seen?"""
    return audited(moves(spark, sf), MOVES, "store_id", KEYS, folds=2, trees=8)
