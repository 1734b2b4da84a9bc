"""The action queue with its texts, and what readers ask of the marts: summaries, rankings, profiles and point lookups.

A lookup checks its ids first: an unknown store or category is an error, a known pair
without rows is an empty answer.  Marts are joined by month, too: without it each
signal would meet the prices of all months.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gondola.config import T
from gondola.functions.exprs import clamp, first_match, half_up, looked_up, whole
from gondola.operators.windows import numbered
from gondola.plans.core import dim_category, dim_date_spine, dim_location, store_labels
from gondola.plans.facts import KEYS, events, prices, signals
from gondola.plans.pricing import pricing
from gondola.plans.registry import cl, query, r, view
from gondola.plans.scores import ready
from gondola.sources.tables import SHELF, collected
from gondola.sources.costs import MOST_BYTES, capped
from gondola.sources.workspace import mart

#: The actions in the order of their priority, with urgency, driving score, mart and reason.
ACTIONS = {
    "AVOID": ("URGENT", "driver of the two", "shelf_risk / price_margin", "DEMAND_DECAY_OR_MARGIN_RISK"), "EXPAND": ("HIGH", "ready", "expansion_readiness", "HIGH_DEMAND_LOW_SHELF"),
    "DEFEND": ("HIGH", "threat", "shelf_risk", "COMPETITOR_THREAT_HIGH"), "PITCH": ("HIGH", "ready", "expansion_readiness", "DEMAND_RISING_SHELF_GAP"),
    "REPRICE": ("MEDIUM", "place", "price_margin", "OVERPRICED_VS_COMPETITOR"), "CUTPROMO": ("MEDIUM", "promo_risk", "price_margin", "PROMO_RISK_MARGIN_PRESSURE"),
    "MONITOR": ("LOW", "demand", "demand_gap", "MIXED_SIGNALS"), "INVESTIGATE": ("LOW", "confidence", "confidence_layer", "LOW_CONFIDENCE")}
_ORDER = "CASE action " + " ".join(f"WHEN '{a}' THEN {k}" for k, a in enumerate(ACTIONS, 1)) + " END"
_OF = lambda k: "CASE action " + " ".join(f"WHEN '{a}' THEN '{v[k]}'" for a, v in ACTIONS.items()) + " END"
_INT = lambda x: f"CAST({r(x, 0)} AS BIGINT)::VARCHAR"

view("v_acted", f"""SELECT s.*, store_name, support, safety, intensity, CASE WHEN retail IS NULL OR s.confidence < {T.trusted} OR completeness < 60 THEN 'INVESTIGATE' WHEN s.decay > 70 OR s.margin > {T.margin_avoid} THEN 'AVOID' WHEN ready > {T.expand_ready} AND s.confidence > {T.expand_confidence} THEN 'EXPAND' WHEN s.threat > 70 THEN 'DEFEND'
  WHEN ready BETWEEN {T.pitch_floor} AND {T.expand_ready} AND s.demand > 60 THEN 'PITCH' WHEN place > 70 AND s.demand > 50 THEN 'REPRICE' WHEN s.promo_risk > 70 THEN 'CUTPROMO' WHEN s.confidence >= 60 AND ready < {T.pitch_floor} THEN 'MONITOR' ELSE 'INVESTIGATE' END AS action,
  {r(cl('0.25 * s.demand + 0.20 * ready + 0.20 * (100 - shelf_risk) + 0.15 * s.confidence + 0.10 * coalesce(support, 50) + 0.10 * (100 - margin_risk)'), 1)} AS opportunity
  FROM v_ready s LEFT JOIN (SELECT month, store_id, category, support, safety, intensity FROM v_pricing) p ON s.month = p.month AND s.store_id = p.store_id AND s.category = p.category LEFT JOIN v_location l ON s.store_id = l.store_id""")
view("v_queue", f"""SELECT *, {_OF(0)} AS urgency, {_OF(2)} AS source_mart, {_OF(3)} AS reason_code, row_number() OVER (ORDER BY {_ORDER}, month DESC, demand DESC NULLS LAST, store_id, category) AS priority,
  {r("CASE action WHEN 'AVOID' THEN CASE WHEN margin IS NULL THEN decay ELSE greatest(decay, margin) END WHEN 'EXPAND' THEN ready WHEN 'DEFEND' THEN threat WHEN 'PITCH' THEN ready WHEN 'REPRICE' THEN place WHEN 'CUTPROMO' THEN promo_risk WHEN 'MONITOR' THEN demand ELSE confidence END")} AS driver,
  CASE WHEN confidence >= {T.confidence_high} AND (demand > {T.demand_high} OR demand < 35 OR ready > 75 OR shelf_risk > 70) THEN 'Strong' WHEN confidence >= 55 THEN 'Moderate' ELSE 'Weak' END AS strength,
  CASE WHEN opportunity IS NULL THEN 'Unknown' WHEN opportunity >= {T.tier_prime} THEN 'Prime' WHEN opportunity >= {T.tier_solid} THEN 'Solid' WHEN opportunity >= {T.tier_watch} THEN 'Watch' ELSE 'Low' END AS tier,
  CASE WHEN velocity_direction = 'Accelerating' THEN 'Growth Accelerating' WHEN velocity_direction = 'Decelerating' AND search_direction IN ('Rising', 'Stable') THEN 'Growth Slowing' WHEN velocity_direction = 'Decelerating' THEN 'Declining' WHEN coalesce(intensity, 'Sparse') IN ('Sparse', 'Emerging') THEN 'Emerging' ELSE 'Mature' END AS lifecycle,
  CASE WHEN season = 'Possible Seasonal Spike' AND confidence < {T.confidence_high} AND action IN ('EXPAND', 'PITCH') THEN 'MONITOR' ELSE action END AS seasonal_action,
  CASE WHEN season = 'Possible Seasonal Spike' THEN 'SEASONAL_SPIKE' WHEN velocity_direction = 'Accelerating' THEN 'ACCELERATING' WHEN velocity_direction = 'Decelerating' THEN 'DECELERATING' WHEN demand >= {T.demand_high} THEN 'HIGH_STABLE' WHEN demand >= {T.demand_medium} THEN 'MEDIUM_STABLE' WHEN velocity_direction IS NOT NULL THEN 'LOW_STABLE' ELSE 'NO_DATA' END AS demand_code,
  CASE WHEN macro_risk = 'High Inflation Risk' THEN 'HIGH_INFLATION_RISK' WHEN macro_risk = 'Cost Pressure' THEN 'COST_PRESSURE' WHEN macro_risk = 'Cost Relief' THEN 'COST_RELIEF' WHEN intensity = 'Saturated' THEN 'SATURATED_MARKET' WHEN shelf_risk > 70 THEN 'HIGH_OPERATIONAL_RISK' ELSE 'STABLE' END AS risk_code,
  CASE action WHEN 'AVOID' THEN 'Hold the shelf: demand decay ' || {_INT('decay')} || '/100, cost pressure ' || coalesce({_INT('margin')}, 'unknown') || '/100' WHEN 'EXPAND' THEN 'Offer full distribution to ' || coalesce(store_name, store_id::VARCHAR) || ': readiness ' || {_INT('ready')} || '/100, confidence ' || {_INT('confidence')} || '/100'
    WHEN 'DEFEND' THEN 'Competitive threat ' || {_INT('threat')} || '/100: match prices or promote at ' || coalesce(store_name, store_id::VARCHAR) WHEN 'PITCH' THEN 'Prepare the sell-in: readiness ' || {_INT('ready')} || '/100, demand gap ' || {_INT('demand')} || '/100'
    WHEN 'REPRICE' THEN 'Price position ' || {_INT('place')} || '/100 is above the consumer index: review it for a demand gap of ' || {_INT('demand')} || '/100' WHEN 'CUTPROMO' THEN 'Promotion risk ' || {_INT('promo_risk')} || '/100: promote less deep or less often'
    WHEN 'MONITOR' THEN 'Mid-range: demand gap ' || {_INT('demand')} || ', risk ' || {_INT('shelf_risk')} || ', readiness ' || {_INT('ready')} ELSE 'Check the data of ' || category || ' at ' || coalesce(store_name, store_id::VARCHAR) || ': confidence ' || {_INT('confidence')} || '/100' END AS description FROM v_acted""")


def action_rule() -> Column:
    """The ordered actions; a predicate on an unknown score does not hold."""
    c = F.col
    return first_match([
        (c("retail").isNull() | (c("confidence") < T.trusted) | (c("completeness") < 60), "INVESTIGATE"), ((c("decay") > 70) | (c("margin") > T.margin_avoid), "AVOID"),
        ((c("ready") > T.expand_ready) & (c("confidence") > T.expand_confidence), "EXPAND"), (c("threat") > 70, "DEFEND"), (c("ready").between(T.pitch_floor, T.expand_ready) & (c("demand") > 60), "PITCH"),
        ((c("place") > 70) & (c("demand") > 50), "REPRICE"), (c("promo_risk") > 70, "CUTPROMO"), ((c("confidence") >= 60) & (c("ready") < T.pitch_floor), "MONITOR")], "INVESTIGATE")


def opportunity_parts() -> dict[str, Column]:
    """What the opportunity score weighs, by the names of its weights."""
    c = F.col
    return {"demand": c("demand"), "ready": c("ready"), "shelf_risk_inv": 100 - c("shelf_risk"), "confidence": c("confidence"), "pricing_power": F.coalesce("support", F.lit(50.0)), "margin_risk_inv": 100 - c("margin_risk")}


def tier(score: Column) -> Column:
    return first_match([(score.isNull(), "Unknown"), (score >= T.tier_prime, "Prime"), (score >= T.tier_solid, "Solid"), (score >= T.tier_watch, "Watch")], "Low")


def acted(x: DataFrame) -> DataFrame:
    """Scores (with support, safety, intensity and store_name) with action, opportunity, context, codes and text."""
    c = F.col
    x = x.withColumns({"action": action_rule(), "opportunity": half_up(clamp(sum(T.opportunity[k] * p for k, p in opportunity_parts().items())), 1)})
    is_ = lambda *names: c("action").isin(*names)
    driver = (
        F.when(is_("AVOID"), F.greatest("decay", "margin")).when(is_("EXPAND", "PITCH"), c("ready")).when(is_("DEFEND"), c("threat")).when(is_("REPRICE"), c("place"))
        .when(is_("CUTPROMO"), c("promo_risk")).when(is_("MONITOR"), c("demand")).otherwise(c("confidence")))
    extreme = (c("demand") > T.demand_high) | (c("demand") < 35) | (c("ready") > 75) | (c("shelf_risk") > 70)
    slower, faster, spike = c("velocity_direction") == "Decelerating", c("velocity_direction") == "Accelerating", F.coalesce(c("season") == "Possible Seasonal Spike", F.lit(False))
    rivalry = F.coalesce("intensity", F.lit("Sparse"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    store, n = F.coalesce("store_name", c("store_id").cast("string")), lambda k: whole(c(k))
    text = (
        F.when(is_("AVOID"), say("Hold the shelf: demand decay ", n("decay"), "/100, cost pressure ", F.coalesce(n("margin"), F.lit("unknown")), "/100"))
        .when(is_("EXPAND"), say("Offer full distribution to ", store, ": readiness ", n("ready"), "/100, confidence ", n("confidence"), "/100"))
        .when(is_("DEFEND"), say("Competitive threat ", n("threat"), "/100: match prices or promote at ", store))
        .when(is_("PITCH"), say("Prepare the sell-in: readiness ", n("ready"), "/100, demand gap ", n("demand"), "/100"))
        .when(is_("REPRICE"), say("Price position ", n("place"), "/100 is above the consumer index: review it for a demand gap of ", n("demand"), "/100"))
        .when(is_("CUTPROMO"), say("Promotion risk ", n("promo_risk"), "/100: promote less deep or less often"))
        .when(is_("MONITOR"), say("Mid-range: demand gap ", n("demand"), ", risk ", n("shelf_risk"), ", readiness ", n("ready")))
        .otherwise(say("Check the data of ", c("category"), " at ", store, ": confidence ", n("confidence"), "/100")))
    facts = {name: looked_up(c("action"), {a: v[k] for a, v in ACTIONS.items()}, None) for k, name in ((0, "urgency"), (2, "source_mart"), (3, "reason_code"))}
    return x.withColumns(facts | {
        "driver": half_up(driver), "description": text, "tier": tier(c("opportunity")),
        "strength": first_match([((c("confidence") >= T.confidence_high) & extreme, "Strong"), (c("confidence") >= 55, "Moderate")], "Weak"),
        "lifecycle": first_match([(faster, "Growth Accelerating"), (slower & c("search_direction").isin("Rising", "Stable"), "Growth Slowing"), (slower, "Declining"), (rivalry.isin("Sparse", "Emerging"), "Emerging")], "Mature"),
        "seasonal_action": F.when(spike & (c("confidence") < T.confidence_high) & is_("EXPAND", "PITCH"), "MONITOR").otherwise(c("action")),
        "demand_code": first_match([
            (spike, "SEASONAL_SPIKE"), (faster, "ACCELERATING"), (slower, "DECELERATING"), (c("demand") >= T.demand_high, "HIGH_STABLE"), (c("demand") >= T.demand_medium, "MEDIUM_STABLE"),
            (c("velocity_direction").isNotNull(), "LOW_STABLE")], "NO_DATA"),
        "risk_code": first_match([
            (c("macro_risk") == "High Inflation Risk", "HIGH_INFLATION_RISK"), (c("macro_risk") == "Cost Pressure", "COST_PRESSURE"), (c("macro_risk") == "Cost Relief", "COST_RELIEF"),
            (rivalry == "Saturated", "SATURATED_MARKET"), (c("shelf_risk") > 70, "HIGH_OPERATIONAL_RISK")], "STABLE")})


@mart("month", "store_id", "category")
def actions(spark, sf) -> DataFrame:
    """One action a signal."""
    intel = pricing(spark, sf).select(*KEYS, "support", "safety", "intensity")
    names = dim_location(spark, sf).select("store_id", "store_name")  # one row a store
    return acted(ready(spark, sf).join(intel, KEYS, "left").join(F.broadcast(names), "store_id", "left"))


@mart("month", "store_id", "category", below=actions)
def queue(spark, sf) -> DataFrame:
    """actions() with the place of each among all."""
    c, x = F.col, actions(spark, sf)
    rank = looked_up(c("action"), {a: k for k, a in enumerate(ACTIONS, 1)}, None)
    # descending as ascending negatives; unknown scores last
    return numbered(x, [rank, -F.unix_date("month"), c("demand").isNull(), -F.coalesce("demand", F.lit(0.0)), c("store_id"), c("category")], "priority")


def scored(spark, sf) -> DataFrame:
    """The rows of queue() with their scores alone, for readers of nothing that rests on price actions: the price marts are not built for them.

    pricing() has one row at most for a signal, so it adds none; a store that is listed twice has its signals twice here, too.
    """
    return ready(spark, sf).join(store_labels(spark, sf).select("store_id"), "store_id", "left")


_QUEUE_COLUMNS = ["action", "urgency", "strength", "driver", "source_mart", "reason_code", "description", "opportunity", "tier", "lifecycle", "seasonal_action", "demand_code", "risk_code", "priority", "store_name",
                  "demand", "confidence", "shelf_risk", "margin_risk", "coverage", "velocity_direction", "search_direction", "season", "macro_risk", "macro", "intensity", "support", "safety"]


@query(f"SELECT month, store_id, category, {', '.join(_QUEUE_COLUMNS)}, CASE WHEN rival_mean IS NOT NULL THEN 'MEASURED' ELSE 'PROXY' END AS signal_type FROM v_queue ORDER BY opportunity DESC NULLS LAST, confidence DESC")
def action_queue(spark, sf):
    c = F.col
    kind = F.when(c("rival_mean").isNotNull(), "MEASURED").otherwise("PROXY")
    return queue(spark, sf).select(*KEYS, *_QUEUE_COLUMNS, kind.alias("signal_type")).orderBy(c("opportunity").desc_nulls_last(), F.desc("confidence"))


@query("SELECT month, store_id, category, action, urgency, driver, opportunity, strength FROM v_queue")
def action_cascade(spark, sf):
    return queue(spark, sf).select(*KEYS, "action", "urgency", "driver", "opportunity", "strength")


@query("SELECT month, store_id, category, action, demand FROM v_queue WHERE action NOT IN ('MONITOR', 'INVESTIGATE') ORDER BY demand DESC, month, store_id, category LIMIT 5")
def topk_actions(spark, sf):
    x = queue(spark, sf).where(~F.col("action").isin("MONITOR", "INVESTIGATE"))
    return x.orderBy(F.desc("demand"), "month", "store_id", "category").select(*KEYS, "action", "demand").limit(5)


@query("SELECT month, store_id, category, priority, action FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY priority) AS k FROM v_queue) WHERE k <= 5")
def top_actions_per_store(spark, sf):
    """The five most pressing actions of each store; the limit on the rank is applied before rows are shuffled, too."""
    per = Window.partitionBy("store_id").orderBy("priority")
    return queue(spark, sf).select(*KEYS, "priority", "action").withColumn("k", F.row_number().over(per)).where("k <= 5").drop("k")


@query(f"""SELECT *, CAST(row_number() OVER (ORDER BY health DESC NULLS LAST, store_id) AS BIGINT) AS place, {r('health - avg(health) OVER ()', 1)} AS delta FROM (SELECT store_id, any_value(store_name) AS store_name, {r('avg(demand)', 1)} AS demand, {r('avg(confidence)', 1)} AS confidence, {r('avg(ready)', 1)} AS ready, {r('avg(100 - shelf_risk)', 1)} AS safety, {r('(avg(demand) + avg(confidence) + avg(ready)) / 3', 1)} AS health, count_if(action = 'AVOID') AS avoid
FROM v_queue GROUP BY store_id) ORDER BY place""")
def store_health(spark, sf):
    """Stores by the mean of three scores, with their place and their distance from the mean store."""
    c = F.col
    mean = {k: F.avg(k) for k in ("demand", "confidence", "ready")}
    x = queue(spark, sf).groupBy("store_id").agg(
        F.any_value("store_name", True).alias("store_name"), *[half_up(m, 1).alias(k) for k, m in mean.items()], half_up(F.avg(100 - c("shelf_risk")), 1).alias("safety"),
        half_up(sum(mean.values()) / 3, 1).alias("health"), F.count_if(c("action") == "AVOID").alias("avoid"))
    # one row a store
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(c("health").desc_nulls_last(), "store_id")).cast("long")
    return x.withColumns({"place": place, "delta": half_up(c("health") - F.avg("health").over(every), 1)}).orderBy("place")


@query(f"""SELECT (SELECT category FROM v_queue GROUP BY category ORDER BY {r('avg(opportunity)', 6)} DESC NULLS LAST, category LIMIT 1) AS top_category, count(DISTINCT CASE WHEN season = 'Possible Seasonal Spike' THEN category END) AS spiking,
  count(DISTINCT CASE WHEN velocity_direction = 'Accelerating' THEN category END) AS accelerating, {r('avg(ready)', 1)} AS ready, {r('avg(confidence)', 1)} AS confidence, {r('avg(100 - shelf_risk)', 1)} AS safety, arg_max(macro_risk, month) AS macro_env, max(month) AS latest FROM v_queue""")
def intelligence_summary(spark, sf):
    """One row over all signals; categories are aggregated first, so one pass gives all of it."""
    c = F.col
    per = queue(spark, sf).groupBy("category").agg(
        F.avg("opportunity").alias("o"), F.max(F.coalesce(c("season") == "Possible Seasonal Spike", F.lit(False))).alias("spike"), F.max(F.coalesce(c("velocity_direction") == "Accelerating", F.lit(False))).alias("fast"),
        F.max("month").alias("latest"), F.max_by("macro_risk", F.when(c("macro_risk").isNotNull(), c("month"))).alias("env"), F.max(F.when(c("macro_risk").isNotNull(), c("month"))).alias("env_month"),
        *[f(k).alias(f"{n}_{k}") for k in ("ready", "confidence", "shelf_risk") for f, n in ((F.sum, "s"), (F.count, "n"))])
    mean = lambda k: F.try_divide(F.sum(f"s_{k}"), F.sum(f"n_{k}"))
    best = F.min_by("category", F.struct(c("o").isNull(), -half_up(c("o"), 6), c("category")))
    return per.agg(
        best.alias("top_category"), F.count_if("spike").alias("spiking"), F.count_if("fast").alias("accelerating"), half_up(mean("ready"), 1).alias("ready"), half_up(mean("confidence"), 1).alias("confidence"),
        half_up(100 - mean("shelf_risk"), 1).alias("safety"), F.max_by("env", "env_month").alias("macro_env"), F.max("latest").alias("latest"))


@query(f"SELECT category, {r('avg(opportunity)', 1)} AS opportunity, count(*) AS signals, count(opportunity) AS known FROM v_queue GROUP BY category ORDER BY opportunity DESC NULLS LAST, category")
def category_opportunity(spark, sf):
    return queue(spark, sf).groupBy("category").agg(half_up(F.avg("opportunity"), 1).alias("opportunity"), F.count("*").alias("signals"), F.count("opportunity").alias("known")).orderBy(F.col("opportunity").desc_nulls_last(), "category")


@query(f"SELECT {r('avg(ready)', 1)} AS avg_val FROM v_queue")
def expansion_avg(spark, sf):
    return scored(spark, sf).agg(half_up(F.avg("ready"), 1).alias("avg_val"))


@query(f"SELECT {r('avg(confidence)', 1)} AS avg_val FROM v_queue")
def avg_confidence(spark, sf):
    return scored(spark, sf).agg(half_up(F.avg("confidence"), 1).alias("avg_val"))


@query(f"SELECT coalesce({r('avg(demand)', 1)}, 50) AS demand, coalesce({r('avg(ready)', 1)}, 50) AS expansion, coalesce({r('avg(support)', 1)}, 50) AS premium_support, coalesce({r('avg(confidence)', 1)}, 50) AS confidence, coalesce({r('100 - avg(shelf_risk)', 1)}, 50) AS risk_inv, coalesce({r('avg(safety)', 1)}, 50) AS markdown_safety FROM v_queue")
def average_scores(spark, sf):
    """The six means that a store is compared with; unknown ones count as 50."""
    mean = {"demand": F.avg("demand"), "expansion": F.avg("ready"), "premium_support": F.avg("support"), "confidence": F.avg("confidence"), "risk_inv": 100 - F.avg("shelf_risk"), "markdown_safety": F.avg("safety")}
    return queue(spark, sf).agg(*[F.coalesce(half_up(m, 1), F.lit(50.0)).alias(k) for k, m in mean.items()])


@query(f"""SELECT p.month, p.store_id, p.category, p.price_action, p.shelf_price, p.advised, p.action_score, {r('p.gap', 1)} AS gap, p.tier FROM v_pricing p WHERE price_action NOT IN ('Monitor', 'Investigate') ORDER BY action_score DESC, abs(adjusted) DESC NULLS LAST, month, store_id, category LIMIT 5""")
def top_pricing_actions(spark, sf):
    c = F.col
    x = pricing(spark, sf).where(~c("price_action").isin("Monitor", "Investigate"))
    x = x.orderBy(F.desc("action_score"), F.abs("adjusted").desc_nulls_last(), "month", "store_id", "category").limit(5)
    return x.select(*KEYS, "price_action", "shelf_price", "advised", "action_score", half_up(c("gap"), 1).alias("gap"), "tier")


@query("SELECT p.month, p.store_id, p.category, price_action, action_score, macro_risk FROM v_pricing p LEFT JOIN (SELECT month, store_id, category, macro_risk FROM v_queue) q ON p.month = q.month AND p.store_id = q.store_id AND p.category = q.category ORDER BY action_score DESC")
def pricing_with_macro(spark, sf):
    risk = queue(spark, sf).select(*KEYS, "macro_risk")
    return pricing(spark, sf).select(*KEYS, "price_action", "action_score").join(risk, KEYS, "left").orderBy(F.desc("action_score"))


@query(f"""SELECT month, store_id, coalesce(store_name, store_id::VARCHAR) AS store_name, category, demand, shelf_gap, momentum, intent, phantom, CASE WHEN n_products IS NULL THEN 'MISSING' ELSE 'MEASURED' END AS phantom_signal, ready, search_direction, ppi_direction, cpi_direction, velocity_direction, season FROM v_queue ORDER BY demand DESC""")
def demand_scores(spark, sf):
    c = F.col
    return queue(spark, sf).select(
        "month", "store_id", F.coalesce("store_name", c("store_id").cast("string")).alias("store_name"), "category", "demand", "shelf_gap", "momentum", "intent", "phantom",
        F.when(c("n_products").isNull(), "MISSING").otherwise("MEASURED").alias("phantom_signal"), "ready", "search_direction", "ppi_direction", "cpi_direction", "velocity_direction", "season").orderBy(F.desc("demand"))


_KPIS = ["URGENT", "HIGH", "MEDIUM", "LOW"]


@query("SELECT count(*) AS signals, " + ", ".join(f"count_if(urgency = '{u}') AS {u.lower()}" for u in _KPIS) + ", count_if(strength = 'Strong') AS strong, count(DISTINCT CASE WHEN action = 'DEFEND' THEN store_id END) AS defended_stores, count_if(tier = 'Prime') AS prime FROM v_queue WHERE month = (SELECT max(month) FROM v_queue)")
def latest_kpis(spark, sf):
    """The counts of the latest month: a filter on the stored month, then one pass."""
    c = F.col
    x = queue(spark, sf)
    at = x.join(F.broadcast(x.agg(F.max("month").alias("month"))), "month", "left_semi")  # one row
    return at.agg(
        F.count("*").alias("signals"), *[F.count_if(c("urgency") == u).alias(u.lower()) for u in _KPIS], F.count_if(c("strength") == "Strong").alias("strong"),
        F.count_distinct(F.when(c("action") == "DEFEND", c("store_id"))).alias("defended_stores"), F.count_if(c("tier") == "Prime").alias("prime"))


@query("SELECT event_type, e.store_id, e.category, detail, event_rank, q.action, q.reason_code FROM v_event e LEFT JOIN (SELECT month, store_id, category, action, reason_code FROM v_queue) q ON e.month = q.month AND e.store_id = q.store_id AND e.category = q.category WHERE event_rank <= 5")
def events_with_reasons(spark, sf):
    """The five first events of each kind, with what the queue says about the signal."""
    top = events(prices(spark, sf)).where("event_rank <= 5").select("event_type", *KEYS, "detail", "event_rank")
    return top.join(queue(spark, sf).select(*KEYS, "action", "reason_code"), KEYS, "left").drop("month")


@query(f"SELECT store_id, category, count(*) AS months, {r('avg(demand)', 1)} AS demand FROM v_queue WHERE month > (SELECT max(month) FROM v_queue) - INTERVAL 12 MONTH GROUP BY ALL")
def trailing_year(spark, sf):
    """The last twelve months of each pair."""
    x = scored(spark, sf).select(*KEYS, "demand")
    last = F.broadcast(x.agg(F.max("month").alias("last")))  # one row
    return x.join(last).where(F.col("month") > F.add_months("last", -12)).groupBy("store_id", "category").agg(F.count("*").alias("months"), half_up(F.avg("demand"), 1).alias("demand"))


@query("SELECT q.month, q.store_id, q.category, q.demand, p.gap, p.adjusted FROM v_queue q JOIN v_pricing p ON q.month = p.month AND q.store_id = p.store_id AND q.category = p.category WHERE q.demand IS NOT NULL AND p.gap IS NOT NULL AND p.adjusted IS NOT NULL")
def aligned_scores(spark, sf):
    """Two marts side by side, rows with unknown values left out: an inner join, not an alignment by place."""
    return queue(spark, sf).select(*KEYS, "demand").join(pricing(spark, sf).select(*KEYS, "gap", "adjusted"), KEYS).dropna()


@query("SELECT store_id, " + ", ".join(f"coalesce({r(f'avg(demand) FILTER (category = {chr(39)}{k}{chr(39)})', 1)}, 0) AS {k.lower()}" for k in SHELF) + " FROM v_queue GROUP BY store_id")
def demand_heatmap(spark, sf):
    """Stores x categories by mean demand, 0 where there is none; the columns are fixed, so no pass looks for them first."""
    x = scored(spark, sf).groupBy("store_id").pivot("category", list(SHELF)).agg(F.avg("demand"))
    return x.select("store_id", *[F.coalesce(half_up(F.col(k), 1), F.lit(0.0)).alias(k.lower()) for k in SHELF])


@query("SELECT signal_id, d.month AS date_day, c.category, c.parent, l.store_name, l.city, l.state, l.region FROM (SELECT signal_id, md5(month::VARCHAR) AS date_key, md5(category) AS category_key, md5(store_id::VARCHAR) AS location_key FROM v_signal) s LEFT JOIN (SELECT month, md5(month::VARCHAR) AS date_key FROM v_months) d USING (date_key) LEFT JOIN v_category c USING (category_key) LEFT JOIN v_location l USING (location_key)")
def star_lookup(spark, sf):
    """Signals by their surrogate keys alone, looked up in the dimensions: days, categories and stores, each broadcast if it is small enough."""
    md5 = lambda k: F.md5(F.col(k).cast("string").cast("binary"))
    s = signals(spark, sf).select("signal_id", md5("month").alias("date_key"), md5("category").alias("category_key"), md5("store_id").alias("location_key"))
    days = dim_date_spine(spark, sf).select("date_key", "date_day")
    # the first of the first month may lie before the first day
    first = days.agg(F.trunc(F.min("date_day"), "MONTH").alias("date_day")).select(md5("date_day").alias("date_key"), "date_day")
    days = days.unionByName(first).distinct()
    return s.join(days, "date_key", "left").join(dim_category(spark, sf), "category_key", "left").join(dim_location(spark, sf).drop("store_id"), "location_key", "left").select(
        "signal_id", "date_day", "category", "parent", "store_name", "city", "state", "region")


@query("SELECT store_id, store_name AS display_name FROM v_location ORDER BY display_name")
def store_list(spark, sf):
    """Stores and their names, from the stored queue: two columns of one file set."""
    return queue(spark, sf).select("store_id", F.col("store_name").alias("display_name")).distinct().orderBy("display_name")


@query("SELECT 'retail' AS source, CAST(max(l_shipdate) AS DATE) AS last_updated FROM lineitem UNION ALL SELECT 'rival', CAST(max(l_shipdate) AS DATE) FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'terms', CAST(max(ts) AS DATE) FROM events UNION ALL SELECT 'producer', CAST(producer AS DATE) FROM v_collected UNION ALL SELECT 'consumer', CAST(consumer AS DATE) FROM v_collected")
def data_freshness(spark, sf):
    names = ["retail", "rival", "terms", "producer", "consumer"]
    return collected(spark, sf).unpivot([], names, "source", "last").select("source", F.to_date("last").alias("last_updated"))


@query("SELECT count(DISTINCT (retail_hours, producer_hours, consumer_hours, rival_hours, terms_hours, recency)) AS combos, any_value(retail_hours) AS retail_hours, any_value(producer_hours) AS producer_hours, any_value(consumer_hours) AS consumer_hours, any_value(rival_hours) AS rival_hours, any_value(terms_hours) AS terms_hours, any_value(recency) AS recency, count(DISTINCT (retail_hours, producer_hours, consumer_hours, rival_hours, terms_hours, recency)) <> 1 AS anomaly FROM v_conf")
def check_data_freshness(spark, sf):
    """Hours since each source was collected; all signals must agree, or the clock they share is broken."""
    hours = [f"{k}_hours" for k in ("retail", "producer", "consumer", "rival", "terms")]
    combos = F.count_distinct(F.struct(*hours, "recency"))
    return ready(spark, sf).agg(combos.alias("combos"), *[F.any_value(k, True).alias(k) for k in (*hours, "recency")], (combos != 1).alias("anomaly"))


# --- lookups --------------------------------------------------------------------------------------


class UnknownId(ValueError):
    """A store or category that does not occur."""


def _known(df: DataFrame, column: str, value: object) -> None:
    if df.where(F.col(column) == F.lit(value)).select(F.lit(1)).isEmpty():
        raise UnknownId(f"no {column} {value!r}")


def store_category(df: DataFrame, store_id: int, category: str, month: date | None = None) -> DataFrame:
    """The row of a store and category in a month, or its latest one; no row: an empty answer."""
    _known(df, "store_id", store_id)
    _known(df, "category", category)
    found = df.where((F.col("store_id") == store_id) & (F.col("category") == category))
    if month is not None:
        found = found.where(F.col("month") == F.lit(month))
    return found.orderBy(F.desc("month")).limit(1)


def price_history(df: DataFrame, store_id: int, category: str, periods: int = 13) -> DataFrame:
    """The latest periods of a store and category, the latest first."""
    if periods < 1:
        raise ValueError("periods must be positive")
    _known(df, "store_id", store_id)
    _known(df, "category", category)
    return df.where((F.col("store_id") == store_id) & (F.col("category") == category)).orderBy(F.desc("month")).limit(periods)


def asked(spark: SparkSession, statement: str, most: int, most_bytes: int = MOST_BYTES, **arguments: object) -> DataFrame:
    """A statement with named parameters, which are values and never text of the statement, a bound on its answer and one on what it may read."""
    return capped(spark.sql(statement, args=arguments), most_bytes).limit(most)


@query("SELECT month, price, gap, gap_direction, position, reliability, stale, products, mismatch FROM v_fact WHERE store_id = 7 AND category = 'SMALL' ORDER BY month DESC LIMIT 13")
def price_history_lookup(spark, sf):
    return price_history(prices(spark, sf), 7, "SMALL").select("month", "price", "gap", "gap_direction", "position", "reliability", "stale", "products", "mismatch")


@query("SELECT month, action, opportunity, demand FROM v_queue WHERE store_id = 7 AND category = 'SMALL' ORDER BY month DESC LIMIT 1")
def store_category_lookup(spark, sf):
    return store_category(queue(spark, sf).select(*KEYS, "action", "opportunity", "demand"), 7, "SMALL").select("month", "action", "opportunity", "demand")


_PROFILE = ["action", "strength", "demand", "confidence", "shelf_risk", "margin_risk", "reason_code", "ready", "region", "fit", "opportunity", "tier", "lifecycle", "velocity_direction", "demand_code", "risk_code", "macro_risk"]
_PROFILE_PRICES = ["support", "safety", "shelf_price", "competitor", "gap", "advised", "price_action", "price_reason", "situation", "action_score", "demand_signal"]


@query(f"SELECT q.month, q.category, {', '.join('q.' + k for k in _PROFILE)}, {', '.join('p.' + k for k in _PROFILE_PRICES)} FROM v_queue q LEFT JOIN v_pricing p ON q.month = p.month AND q.store_id = p.store_id AND q.category = p.category WHERE q.store_id = 7 ORDER BY q.opportunity DESC NULLS LAST, q.confidence DESC")
def store_scores(spark, sf):
    """The profile of one store: a point filter on both marts, then their join."""
    return store_profile(queue(spark, sf), pricing(spark, sf), 7)


def store_profile(actions: DataFrame, intel: DataFrame, store_id: int) -> DataFrame:
    at = F.col("store_id") == store_id
    q = actions.where(at).select("month", "category", *_PROFILE)
    p = intel.where(at).select("month", "category", *_PROFILE_PRICES)
    return q.join(p, ["month", "category"], "left").orderBy(F.col("opportunity").desc_nulls_last(), F.desc("confidence"))


#: The tools that an agent may call, by name.
TOOLS = {"query_store_category": store_category, "get_price_history": price_history, "check_data_freshness": check_data_freshness}
