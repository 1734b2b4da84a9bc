"""Trend features, the monthly signals, the price fact with its history, and the events of the latest month.

A signal is a month x store x category; the price fact has the same grain, for the
collections that there were.  Marts are stored once an application (`workspace.mart`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.config import T
from gondola.functions.exprs import clamp, first_match, half_up, looked_up, pct_change
from gondola.operators.joins import asof
from gondola.operators.windows import islands, middle, numbered_within, once
from gondola.plans.core import competitor_pulls, sql_lookup
from gondola.plans.registry import cl, query, r, view
from gondola.sources.tables import CONSUMER, OWN_BRANDS, PRODUCER, RIVAL_STORES, TERMS, conformed, interest, producer_index
from gondola.sources.workspace import mart

KEYS = ["month", "store_id", "category"]

# --- trends ---------------------------------------------------------------------------------------

view("v_trend", f"""SELECT series_id, month, v, d AS trend, (v - y) / nullif(y, 0) * 100 AS yoy, {cl('50 + d * 10')} AS score,
  CASE WHEN d > {T.index_move} THEN 'Rising' WHEN d < -{T.index_move} THEN 'Falling' WHEN d IS NOT NULL THEN 'Stable' END AS direction
  FROM (SELECT *, avg(v) OVER (s ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) - avg(v) OVER (s ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS d, lag(v, 12) OVER s AS y
    FROM (SELECT series_id, month, value / {T.index_scale}::DOUBLE AS v FROM v_index) WINDOW s AS (PARTITION BY series_id ORDER BY month))""")


def trends(spark, sf) -> DataFrame:
    """Each index by month: its mean of three months against the three before, and a year ago."""
    w = Window.partitionBy("series_id").orderBy("month")
    x = producer_index(spark, sf).select("series_id", "month", (F.col("value") / T.index_scale).alias("v"))
    d = F.avg("v").over(w.rowsBetween(-2, 0)) - F.avg("v").over(w.rowsBetween(-5, -3))
    x = x.withColumns({"trend": d, "yoy": pct_change(F.col("v"), F.lag("v", 12).over(w))})
    t = F.col("trend")
    return x.withColumns({"score": clamp(50 + t * 10), "direction": F.when(t > T.index_move, "Rising").when(t < -T.index_move, "Falling").when(t.isNotNull(), "Stable")})


@query(f"SELECT series_id, month, {r('trend', 4)} AS trend, {r('yoy')} AS yoy_pct, {r('score')} AS score, direction FROM v_trend")
def macro_features(spark, sf):
    c = F.col
    return trends(spark, sf).select("series_id", "month", half_up(c("trend"), 4).alias("trend"), half_up(c("yoy")).alias("yoy_pct"), half_up(c("score")).alias("score"), "direction")


view("v_demand_trend", f"""SELECT *, CASE WHEN step > {T.interest_move} THEN 'Rising' WHEN step < -{T.interest_move} THEN 'Falling' WHEN step IS NOT NULL THEN 'Stable' END AS direction,
  CASE WHEN bend > {T.interest_move} THEN 'Accelerating' WHEN bend < -{T.interest_move} THEN 'Decelerating' ELSE 'Stable Velocity' END AS velocity_direction,
  CASE WHEN year_ago IS NULL THEN 'Insufficient History' WHEN recent > year_ago * {T.season} THEN 'Possible Seasonal Spike' ELSE 'Steady Demand' END AS season,
  CASE WHEN noise IS NULL OR noise = 0 THEN 'Insufficient' WHEN slope / noise > {T.slope_move} THEN 'Rising' WHEN slope / noise < -{T.slope_move} THEN 'Falling' ELSE 'Stable' END AS state,
  {cl('(recent - low) / nullif(high - low, 0) * 100')} AS level, {cl('50 + step * 2')} AS momentum
  FROM (SELECT *, recent - prior AS step, (recent - prior) - (prior - earlier) AS bend FROM (SELECT category AS term, arg_max(interest, day) AS latest,
    avg(interest) FILTER (k <= 4) AS recent, avg(interest) FILTER (k BETWEEN 5 AND 8) AS prior, avg(interest) FILTER (k BETWEEN 9 AND 12) AS earlier, avg(interest) FILTER (k BETWEEN 49 AND 52) AS year_ago,
    regr_slope(interest, -k) FILTER (k <= 8) AS slope, stddev_samp(interest) FILTER (k <= 8) AS noise, max(interest) AS high, min(interest) AS low, count(DISTINCT day) AS weeks
    FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY day DESC) AS k FROM v_interest WHERE interest IS NOT NULL) GROUP BY category))""")


def demand_trends(spark, sf) -> DataFrame:
    """One row a search term: slices of its latest periods, level, momentum, velocity, slope and season."""
    return demand_slices(interest(spark, sf))


def demand_slices(x: DataFrame) -> DataFrame:
    """The same of any (category, day, interest); one pass over ranked rows."""
    c = F.col
    i = x.where("interest is not null").withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("day"))))
    part = lambda a, b: F.avg(F.when(c("k").between(a, b), c("interest")))
    last8 = F.when(c("k") <= 8, c("interest"))
    f = i.groupBy(c("category").alias("term")).agg(
        F.max_by("interest", "day").alias("latest"), part(1, 4).alias("recent"), part(5, 8).alias("prior"), part(9, 12).alias("earlier"), part(49, 52).alias("year_ago"),
        F.regr_slope(last8, -c("k")).alias("slope"), F.stddev_samp(last8).alias("noise"), F.max("interest").alias("high"), F.min("interest").alias("low"), F.count_distinct("day").alias("weeks"))
    f = f.withColumn("step", c("recent") - c("prior")).withColumn("bend", c("step") - (c("prior") - c("earlier")))
    ratio, m = F.try_divide("slope", "noise"), T.interest_move
    return f.withColumns({
        "direction": F.when(c("step") > m, "Rising").when(c("step") < -m, "Falling").when(c("step").isNotNull(), "Stable"),
        "velocity_direction": first_match([(c("bend") > m, "Accelerating"), (c("bend") < -m, "Decelerating")], "Stable Velocity"),
        "season": first_match([(c("year_ago").isNull(), "Insufficient History"), (c("recent") > c("year_ago") * T.season, "Possible Seasonal Spike")], "Steady Demand"),
        "state": first_match([(c("noise").isNull() | (c("noise") == 0), "Insufficient"), (ratio > T.slope_move, "Rising"), (ratio < -T.slope_move, "Falling")], "Stable"),
        "level": clamp(F.try_divide(c("recent") - c("low"), c("high") - c("low")) * 100), "momentum": clamp(50 + c("step") * 2)})


_TREND_OUT = {"latest": 2, "recent": 2, "prior": 2, "earlier": 2, "year_ago": 2, "step": 2, "level": 2, "momentum": 2, "bend": 2, "slope": 3}


@query(f"SELECT term, {', '.join(f'{r(k, d)} AS {k}' for k, d in _TREND_OUT.items())}, {r('slope / nullif(noise, 0)', 3)} AS slope_to_noise, direction, velocity_direction, state, season, weeks FROM v_demand_trend")
def demand_features(spark, sf):
    return demand_trends(spark, sf).select(
        "term", *[half_up(F.col(k), d).alias(k) for k, d in _TREND_OUT.items()], half_up(F.try_divide("slope", "noise"), 3).alias("slope_to_noise"), "direction", "velocity_direction", "state", "season", "weeks")


# --- monthly signals ------------------------------------------------------------------------------

view("v_shelf", """SELECT month, store_id, category, avg(price) AS retail, count(DISTINCT product_id) AS n_products, avg((price - coalesce(promo, price)) / nullif(price, 0)) * 100 AS promo_depth,
  count(*) AS n_items, count_if(promo IS NOT NULL) AS n_promo, avg(coalesce(promo, price)) AS paid_mean FROM v_retail GROUP BY ALL""")
view("v_macro", f"""SELECT p.month, p.trend AS ppi_trend, p.score AS ppi_score, p.direction AS ppi_direction, c.trend AS cpi_trend, c.score AS cpi_score, c.direction AS cpi_direction
  FROM (SELECT * FROM v_trend WHERE series_id = '{PRODUCER}') p LEFT JOIN (SELECT * FROM v_trend WHERE series_id = '{CONSUMER}') c ON p.month = c.month""")
view("v_asof", f"""SELECT m.month, p.month AS ppi_month, p.v AS ppi, c.month AS cpi_month, c.v AS cpi, t.month AS macro_month, t.* EXCLUDE (month) FROM v_months m
  ASOF LEFT JOIN (SELECT * FROM v_trend WHERE series_id = '{PRODUCER}') p ON m.month >= p.month ASOF LEFT JOIN (SELECT * FROM v_trend WHERE series_id = '{CONSUMER}') c ON m.month >= c.month
  ASOF LEFT JOIN v_macro t ON m.month >= t.month""")
view("v_signal", f"""SELECT md5(month::VARCHAR || '||' || category || '||' || store_id::VARCHAR) AS signal_id, s.month, s.store_id, s.category, x.* EXCLUDE (month, store_id, category), a.* EXCLUDE (month),
  ppi_month IS NOT NULL AND cpi_month IS NOT NULL AS macro,
  CASE WHEN ppi_direction IS NULL AND cpi_direction IS NULL THEN NULL WHEN ppi_direction = 'Rising' AND cpi_direction = 'Rising' THEN 'High Inflation Risk' WHEN ppi_direction = 'Rising' THEN 'Cost Pressure'
    WHEN ppi_direction = 'Falling' THEN 'Cost Relief' ELSE 'Stable Macro' END AS macro_risk,
  t.recent AS searched, t.momentum AS search_momentum, t.direction AS search_direction, t.velocity_direction, t.season, t.high, t.low, t.weeks
  FROM (SELECT * FROM v_months CROSS JOIN (SELECT DISTINCT store_id, category FROM v_retail WHERE store_id IS NOT NULL)) s LEFT JOIN v_shelf x USING (month, store_id, category) JOIN v_asof a USING (month)
  LEFT JOIN v_demand_trend t ON t.term = {sql_lookup('category', TERMS, 'NULL')}""")


def monthly_macro(spark, sf, months: DataFrame) -> DataFrame:
    """months with the latest index values and trends that each one knows of; tables of one row a month."""
    x = trends(spark, sf)
    p = x.where(F.col("series_id") == PRODUCER)
    q = x.where(F.col("series_id") == CONSUMER)
    macro = p.select(F.col("month").alias("macro_month"), F.col("trend").alias("ppi_trend"), F.col("score").alias("ppi_score"), F.col("direction").alias("ppi_direction")).join(
        q.select(F.col("month").alias("macro_month"), F.col("trend").alias("cpi_trend"), F.col("score").alias("cpi_score"), F.col("direction").alias("cpi_direction")), "macro_month", "left")
    out = asof(months, p.select(F.col("month").alias("ppi_month"), F.col("v").alias("ppi")), "month", "ppi_month", [], ["ppi"])
    out = asof(out, q.select(F.col("month").alias("cpi_month"), F.col("v").alias("cpi")), "month", "cpi_month", [], ["cpi"])
    return asof(out, macro, "month", "macro_month", [], ["ppi_trend", "ppi_score", "ppi_direction", "cpi_trend", "cpi_score", "cpi_direction"])


def risk_flag(producer: Column, consumer: Column) -> Column:
    return F.when(producer.isNull() & consumer.isNull(), None).otherwise(first_match([
        ((producer == "Rising") & (consumer == "Rising"), "High Inflation Risk"), (producer == "Rising", "Cost Pressure"), (producer == "Falling", "Cost Relief")], "Stable Macro"))


def shelved(x: DataFrame) -> DataFrame:
    """Retail rows as monthly shelves: mean price, products, promotions."""
    c = F.col
    return x.withColumn("fresh", once(c("product_id"), KEYS)).groupBy(*KEYS).agg(
        F.avg("price").alias("retail"), F.count_if("fresh").alias("n_products"), (F.avg(F.try_divide(c("price") - F.coalesce("promo", "price"), c("price"))) * 100).alias("promo_depth"),
        F.count("*").alias("n_items"), F.count_if(c("promo").isNotNull()).alias("n_promo"), F.avg(F.coalesce("promo", "price")).alias("paid_mean"))


@mart("month", "store_id", "category", grows="month")
def shelves(spark, sf) -> DataFrame:
    return shelved(conformed(spark, sf))


@mart("month", "store_id", "category")
def signals(spark, sf) -> DataFrame:
    """Months x segments with what the shelf, the indices and the search terms say; absent parts are null."""
    c = F.col
    shelf = shelves(spark, sf)
    months = shelf.select("month").distinct()
    # one row a month and one a search term
    known, terms = F.broadcast(monthly_macro(spark, sf, months)), F.broadcast(demand_trends(spark, sf).select(
        "term", c("recent").alias("searched"), c("momentum").alias("search_momentum"), c("direction").alias("search_direction"), "velocity_direction", "season", "high", "low", "weeks"))
    spine = known.crossJoin(shelf.where("store_id is not null").select("store_id", "category").distinct()).withColumn("term", looked_up(c("category"), TERMS, None))
    return spine.join(shelf, KEYS, "left").join(terms, "term", "left").drop("term").withColumns({
        "signal_id": F.md5(F.concat_ws("||", c("month").cast("string"), "category", c("store_id").cast("string")).cast("binary")),
        "macro": c("ppi_month").isNotNull() & c("cpi_month").isNotNull(), "macro_risk": risk_flag(c("ppi_direction"), c("cpi_direction"))})


_SIGNAL_OUT = ["signal_id", *KEYS, "ppi_month", "cpi_month", "macro_month", "macro", "macro_risk", "ppi_direction", "cpi_direction", "search_direction", "velocity_direction", "season", "weeks"]
_SIGNAL_ROUND = ["retail", "ppi", "cpi", "ppi_score", "cpi_score", "searched", "search_momentum"]


@query(f"SELECT {', '.join(_SIGNAL_OUT)}, {', '.join(f'{r(k)} AS {k}' for k in _SIGNAL_ROUND)}, retail IS NOT NULL AS has_retail FROM v_signal")
def market_signals(spark, sf):
    return signals(spark, sf).select(*_SIGNAL_OUT, *[half_up(F.col(k)).alias(k) for k in _SIGNAL_ROUND], F.col("retail").isNotNull().alias("has_retail"))


# --- price fact -----------------------------------------------------------------------------------

_BRANDED = " OR ".join(f"starts_with(description, '{b}')" for b in OWN_BRANDS)
_IN = f"price <= {T.outlier_multiple} * m"
view("v_shelved", "SELECT * REPLACE (coalesce(category, 'Unknown') AS category) FROM v_retail")
view("v_median", "SELECT category, month, quantile_disc(price, 0.5) AS m FROM v_shelved WHERE price IS NOT NULL GROUP BY ALL")
view("v_own", f"""SELECT store_id, category, month, {r(f'quantile_disc(CASE WHEN {_IN} THEN price END, 0.5)', 4)} AS price, count(DISTINCT CASE WHEN {_IN} THEN product_id END) AS products, count_if(NOT {_IN}) AS outliers,
  {r(f'count_if({_IN} AND ({_BRANDED})) / nullif(count_if({_IN}), 0)::DOUBLE', 3)} AS own_brand, {r(f'quantile_disc(CASE WHEN {_IN} THEN coalesce(promo, price) END, 0.5)', 4)} AS paid,
  {r(f'count_if({_IN} AND promo IS NOT NULL AND promo < price) / nullif(count_if({_IN}), 0)::DOUBLE', 3)} AS promo_share FROM v_shelved JOIN v_median USING (category, month) WHERE price IS NOT NULL GROUP BY ALL""")
view("v_cv", f"SELECT category, month, {r('stddev_samp(price) / nullif(avg(price), 0) * 100', 1)} AS cv FROM v_shelved JOIN v_median USING (category, month) WHERE {_IN} GROUP BY ALL")
view("v_comp", f"""SELECT category, pulled, competitor, rivals FROM (SELECT category, month AS pulled, {r('quantile_disc(list_price, 0.5)', 4)} AS competitor FROM v_retail WHERE flag = 'R' AND list_price > 0 GROUP BY ALL)
  JOIN (SELECT category, pulled, {r('avg(n)')} AS rivals FROM (SELECT category, month AS pulled, store_id % {RIVAL_STORES} AS rival, count(*) AS n FROM v_retail WHERE flag = 'R' AND list_price > 0 GROUP BY ALL) GROUP BY ALL) USING (category, pulled)""")
view("v_pull", "SELECT month, pulled FROM v_months ASOF LEFT JOIN (SELECT DISTINCT pulled FROM v_comp) ON month >= pulled")
view("v_fact", f"""SELECT *, CASE WHEN gap IS NULL THEN 'Unknown' WHEN price > competitor THEN 'Overpriced' ELSE 'Underpriced' END AS gap_direction,
  CASE WHEN gap IS NULL THEN 'Unknown' WHEN gap > band THEN 'Overpriced' WHEN gap < -band THEN 'Underpriced' ELSE 'Fair' END AS position, coalesce(abs(gap) > {T.gap_low}, false) AS mismatch,
  CASE WHEN gap IS NULL THEN 'Unknown' WHEN rivals < {T.least_products} OR abs(gap) > {T.gap_low} THEN 'Low' WHEN abs(gap) > {T.gap_medium} THEN 'Medium' ELSE 'High' END AS reliability
  FROM (SELECT month, store_id, category, price, products, outliers, own_brand, paid, promo_share, cv, pulled, date_diff('day', pulled, month) AS stale, competitor, coalesce(rivals, 0) AS rivals,
    {r('(price - competitor) / nullif(competitor, 0) * 100')} AS gap, greatest({T.band_min}::DOUBLE, least({T.band_max}::DOUBLE, coalesce(cv, {T.cv_unknown}) * {T.band_per_cv}::DOUBLE)) AS band
    FROM v_own LEFT JOIN v_pull USING (month) LEFT JOIN v_comp USING (category, pulled) LEFT JOIN v_cv USING (category, month))""")
view("v_price", f"""SELECT *, row_number() OVER (PARTITION BY store_id, category, island ORDER BY month) AS run_length, {r('gap - prev_gap')} AS gap_change, seen >= {T.least_history} AND stable AS eligible FROM (SELECT *, sum(change) OVER (PARTITION BY store_id, category ORDER BY month ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, CASE WHEN stable THEN 0 ELSE 1 END AS change FROM (SELECT *, coalesce(gap_direction <> 'Unknown' AND prev_direction <> 'Unknown' AND gap_direction = prev_direction, false) AS stable
    FROM (SELECT *, lag(gap) OVER w AS prev_gap, lag(gap_direction) OVER w AS prev_direction, lag(position) OVER w AS prev_position, count(*) OVER p AS seen, {r('stddev_samp(gap) OVER p')} AS volatility
      FROM v_fact WINDOW w AS (PARTITION BY store_id, category ORDER BY month), p AS (PARTITION BY store_id, category)))))""")


def own_cells(x: DataFrame) -> DataFrame:
    """Store x category x month of retail rows without outliers: medians, counts, shares, and sums for what is worked out of many cells.

    Rows without a category are one category, Unknown, before the medians are taken.
    """
    c = F.col
    priced = x.where("price is not null").withColumn("category", F.coalesce("category", F.lit("Unknown")))
    med = priced.withColumn("m", middle(c("price"), ["category", "month"])).groupBy("category", "month").agg(F.max("m").alias("m"))
    brand = c("description").startswith(OWN_BRANDS[0])
    for b in OWN_BRANDS[1:]:
        brand = brand | c("description").startswith(b)
    # one row a category and month
    rows = priced.join(F.broadcast(med), ["category", "month"]).select(
        *KEYS, "product_id", "m", "price", F.coalesce("promo", "price").alias("paid"), brand.alias("brand"), (c("promo") < c("price")).alias("cut"), (c("price") <= T.outlier_multiple * c("m")).alias("inside"))
    inside = c("inside")
    kept = F.when(inside, c("price"))
    # medians come before the aggregate: beside a distinct count each product would have a sketch of its own, and these are merged one by one
    rows = rows.withColumns({"mid_price": middle(kept, KEYS), "mid_paid": middle(F.when(inside, c("paid")), KEYS)})
    share = lambda p: half_up(F.try_divide(F.count_if(p).cast("double"), F.count_if(inside).cast("double")), 3)
    return rows.groupBy(*KEYS).agg(
        half_up(F.max("mid_price"), 4).alias("price"), F.count_distinct(F.when(inside, c("product_id"))).alias("products"), F.count_if(~inside).alias("outliers"), share(inside & c("brand")).alias("own_brand"),
        half_up(F.max("mid_paid"), 4).alias("paid"), share(inside & c("cut")).alias("promo_share"), F.max("m").alias("m"),
        F.count(kept).alias("n"), F.sum(kept).alias("s1"), F.sum(kept * kept).alias("s2"))


def rival_cells(x: DataFrame) -> DataFrame:
    """Category x collection of the competitor's feed: median and mean price, stores, and products a store on average."""
    c = F.col
    pulls = competitor_pulls(x).where("list_price > 0")
    counts = pulls.groupBy("category", "pulled", (c("store_id") % RIVAL_STORES).alias("rival")).agg(F.count("*").alias("k"))
    sizes = counts.groupBy("category", "pulled").agg(half_up(F.avg("k")).alias("rivals"), F.count("*").alias("rival_stores"))
    placed = pulls.withColumn("mid", middle(c("list_price"), ["category", "pulled"]))
    return placed.groupBy("category", "pulled").agg(half_up(F.max("mid"), 4).alias("competitor"), F.avg("list_price").alias("rival_mean"), F.count("*").alias("rival_n")).join(sizes, ["category", "pulled"])


@mart("month", "store_id", "category", grows="month")
def own_prices(spark, sf) -> DataFrame:
    return own_cells(conformed(spark, sf))


@mart("pulled", "category", grows="pulled")
def rival_prices(spark, sf) -> DataFrame:
    return rival_cells(conformed(spark, sf))


def price_facts(own: DataFrame, comp: DataFrame) -> DataFrame:
    """Own cells beside the competitor's carried ones: gap, band, position, reliability.  Retail rows are not read again."""
    c = F.col
    # the deviation of a category out of the sums of its stores
    total = own.groupBy("category", "month").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(c("s2") - F.try_divide(c("s1") * c("s1"), c("n")), c("n") - 1)))
    cv = total.select("category", "month", F.when(c("n") > 1, half_up(F.try_divide(spread, F.try_divide("s1", "n")) * 100, 1)).alias("cv"))
    # the latest collection of the competitor as of each month, whatever its categories
    carried = asof(own.select("month").distinct(), comp.select("pulled").distinct(), "month", "pulled", [], [])
    gap = half_up(F.try_divide(c("price") - c("competitor"), c("competitor")) * 100)
    found = comp.select("category", "pulled", "competitor", "rivals")
    w = own.drop("m", "n", "s1", "s2").join(cv, ["category", "month"], "left").join(carried, "month", "left").join(found, ["category", "pulled"], "left").withColumns({
        "rivals": F.coalesce("rivals", F.lit(0.0)), "stale": F.date_diff("month", "pulled").cast("long"), "gap": gap,
        "band": F.greatest(F.lit(T.band_min), F.least(F.lit(T.band_max), F.coalesce("cv", F.lit(T.cv_unknown)) * T.band_per_cv))})
    g = c("gap")
    return w.withColumns({
        "gap_direction": first_match([(g.isNull(), "Unknown"), (c("price") > c("competitor"), "Overpriced")], "Underpriced"),
        "position": first_match([(g.isNull(), "Unknown"), (g > c("band"), "Overpriced"), (g < -c("band"), "Underpriced")], "Fair"),
        "mismatch": F.coalesce(F.abs(g) > T.gap_low, F.lit(False)),
        "reliability": first_match([(g.isNull(), "Unknown"), ((c("rivals") < T.least_products) | (F.abs(g) > T.gap_low), "Low"), (F.abs(g) > T.gap_medium, "Medium")], "High")})


def with_history(facts: DataFrame) -> DataFrame:
    """price_facts() with what came before in the same store and category: lags, islands of the gap's direction, volatility."""
    c = F.col
    every = Window.partitionBy("store_id", "category")
    w = every.orderBy("month")
    x = facts.withColumns({
        "prev_gap": F.lag("gap").over(w), "prev_direction": F.lag("gap_direction").over(w), "prev_position": F.lag("position").over(w),
        "seen": F.count("*").over(every), "volatility": half_up(F.stddev_samp("gap").over(every))})
    x = islands(x, ["store_id", "category"], "month", "gap_direction").withColumn("stable", c("change") == 0)
    return x.withColumns({"gap_change": half_up(c("gap") - c("prev_gap")), "eligible": (c("seen") >= T.least_history) & c("stable")})


@mart("month", "store_id", "category")
def prices(spark, sf) -> DataFrame:
    """The price fact of all months with its history."""
    return with_history(price_facts(own_prices(spark, sf), rival_prices(spark, sf)))


_FACT_OUT = ["price", "products", "outliers", "own_brand", "paid", "promo_share", "cv", "pulled", "stale", "competitor", "rivals", "gap", "gap_direction", "position", "mismatch", "reliability"]


@query(f"SELECT month, store_id, category, {', '.join(_FACT_OUT)}, {r('band')} AS band FROM v_fact")
def weekly_price_fact(spark, sf):
    return prices(spark, sf).select(*KEYS, *_FACT_OUT, half_up(F.col("band")).alias("band"))


_HISTORY_OUT = ["gap_direction", "position", "prev_gap", "prev_direction", "prev_position", "stable", "seen", "run_length", "gap_change", "volatility", "eligible"]


@query(f"SELECT month, store_id, category, {', '.join(_HISTORY_OUT)}, change::BIGINT AS change, island::BIGINT AS island FROM v_price")
def gaps_islands(spark, sf):
    return prices(spark, sf).select(*KEYS, *_HISTORY_OUT, F.col("change").cast("long").alias("change"), F.col("island").cast("long").alias("island"))


# --- medians that can be merged -------------------------------------------------------------------

#: Of a sketch with this size the rank of a quantile is off by at most RANK_ERROR of the rows (with 99 % confidence; the tests hold it against exact ranks).
SKETCH_K, RANK_ERROR = 400, 0.008


@mart("month", "store_id", "category", grows="month")
def price_sketches(spark, sf) -> DataFrame:
    """A KLL sketch of the prices of each store, category and month: a few kilobytes, however many rows a cell has."""
    return conformed(spark, sf).where("price is not null").groupBy(*KEYS).agg(F.kll_sketch_agg_double("price", SKETCH_K).alias("sketch"))


def merged_medians(cells: DataFrame, by: list[Column | str]) -> DataFrame:
    """(by, n, median) of any coarser cells: sketches are merged, rows are not read again."""
    merged = cells.groupBy(*by).agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("s"))
    names = merged.columns[:-1]
    return merged.select(*names, F.kll_sketch_get_n_double("s").alias("n"), F.kll_sketch_get_quantile_double("s", F.lit(0.5)).alias("median"))


@query(f"""SELECT category, date_trunc('quarter', month)::DATE AS quarter, count(*) AS n, true AS within FROM v_retail WHERE price IS NOT NULL GROUP BY ALL""")
def sketched_medians(spark, sf):
    """Medians of a category and quarter out of the sketches of its cells, and whether their exact rank is as near to the middle as is promised."""
    quarter = F.trunc("month", "quarter").alias("quarter")
    found = merged_medians(price_sketches(spark, sf), ["category", quarter])
    rows = conformed(spark, sf).where("price is not null").select("category", quarter, "price")
    ranks = rows.join(F.broadcast(found), ["category", "quarter"]).groupBy("category", "quarter", "n").agg(F.count("*").alias("all"), F.count_if(F.col("price") < F.col("median")).alias("below"), F.count_if(F.col("price") <= F.col("median")).alias("upto"))  # one row a category and quarter
    slack = RANK_ERROR * F.col("all") + 1
    near = (F.col("below") <= F.col("all") / 2 + slack) & (F.col("upto") >= F.col("all") / 2 - slack) & (F.col("n") == F.col("all"))
    return ranks.select("category", "quarter", "n", near.alias("within"))


# --- events ---------------------------------------------------------------------------------------

view("v_event", f"""SELECT event_type, store_id, category, month, detail, gap, gap_change, position, prev_position, run_length, reliability, row_number() OVER (PARTITION BY event_type ORDER BY size DESC NULLS LAST, store_id, category) AS event_rank FROM (
  SELECT 'Gap Flip' AS event_type, 'Position changed: ' || prev_position || ' to ' || position AS detail, abs(gap_change) AS size, * FROM v_price WHERE position <> prev_position AND position <> 'Unknown' AND prev_position <> 'Unknown' AND abs(gap_change) <= {T.move_limit}
  UNION ALL SELECT 'Big Move', 'Gap moved ' || CASE WHEN gap_change >= 0 THEN '+' ELSE '' END || {r('gap_change', 1)}::VARCHAR || ' points', abs(gap_change), * FROM v_price WHERE abs(gap_change) >= {T.big_move} AND abs(gap_change) <= {T.move_limit}
  UNION ALL SELECT '3-Collection Streak', position || ' streak reached 3 collections', abs(gap), * FROM v_price WHERE run_length = {T.streak}) WHERE month = (SELECT max(month) FROM v_fact)""")


def events(history: DataFrame) -> DataFrame:
    """What happened in the latest month, ranked within each kind of event."""
    c = F.col
    last = history.agg(F.max("month").alias("month"))  # one row
    at = history.join(F.broadcast(last), "month", "left_semi")
    change = c("gap_change")
    flipped = (c("position") != c("prev_position")) & (c("position") != "Unknown") & (c("prev_position") != "Unknown") & (F.abs(change) <= T.move_limit)
    moved = (F.abs(change) >= T.big_move) & (F.abs(change) <= T.move_limit)
    kind = lambda holds, name, detail, size: F.when(holds, F.struct(F.lit(name).alias("event_type"), detail.alias("detail"), F.abs(size).alias("size")))
    kinds = F.array_compact(F.array(
        kind(flipped, "Gap Flip", F.concat(F.lit("Position changed: "), "prev_position", F.lit(" to "), "position"), change),
        kind(moved, "Big Move", F.concat(F.lit("Gap moved "), F.when(change >= 0, "+").otherwise(""), half_up(change, 1).cast("string"), F.lit(" points")), change),
        kind(c("run_length") == T.streak, "3-Collection Streak", F.concat("position", F.lit(" streak reached 3 collections")), c("gap"))))
    found = at.withColumn("e", F.explode(kinds)).select("e.*", *KEYS, "gap", "gap_change", "position", "prev_position", "run_length", "reliability")
    order = [c("size").isNull(), -c("size"), c("store_id"), c("category")]
    return numbered_within(found, ["event_type"], order, "event_rank").drop("size", "event_rank_of")


@query("SELECT * FROM v_event ORDER BY event_type, event_rank")
def weekly_events(spark, sf):
    return events(prices(spark, sf)).orderBy("event_type", "event_rank")
