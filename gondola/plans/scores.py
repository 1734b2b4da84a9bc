"""Demand gap, shelf risk, margin risk, confidence and expansion readiness of each signal.

Scores are rounded where a mart ends and unrounded within it; a composite takes the
unrounded parts of its own mart and the rounded ones of others.  An absent index
leaves the margin side unknown (null, never a neutral number), and a predicate on an unknown score
does not hold.

Decisions: the competitor's mean price is that of the category (`per_category=False`: of all categories, as the
source of these rules has it); the clock of recency is an input, by default a day after the latest collection;
a price is held against the consumer index in units of `T.price_unit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.config import T
from gondola.functions.exprs import clamp, codes, first_match, half_up, months_between_starts, pct_change
from gondola.operators.joins import asof
from gondola.operators.windows import numbered_within
from gondola.plans.facts import KEYS, rival_prices, signals
from gondola.plans.registry import cl, query, r, view
from gondola.sources.tables import CONSUMER, PRODUCER, RIVAL_STORES, collected, index
from gondola.sources.workspace import mart

# --- demand gap -----------------------------------------------------------------------------------

view("v_demand", f"""SELECT * EXCLUDE (m0, g0, p0, i0), {r('m0')} AS momentum, {r('g0')} AS shelf_gap, {r('p0')} AS phantom, {r('i0')} AS intent, {r(cl('0.25 * m0 + 0.40 * g0 + 0.15 * coalesce(p0, 0) + 0.20 * i0'))} AS demand
  FROM (SELECT *, CASE WHEN macro THEN {cl('coalesce(search_momentum, 50) * 0.8 + (coalesce(cpi_score, 50) + coalesce(ppi_score, 50)) / 2 * 0.2')} ELSE {cl('coalesce(search_momentum, 50)')} END AS m0,
    {cl(f'coalesce(searched, 0) * ({T.shelf_full}::DOUBLE / nullif(coalesce(n_products, 1), 0))')} AS g0,
    CASE WHEN n_products IS NOT NULL THEN {cl(f'coalesce(searched, 0) * greatest(0.0, 1 - n_products / {T.shelf_full}::DOUBLE)')} END AS p0,
    {cl(f'coalesce(weeks, 0) / {T.weeks}::DOUBLE * 60 + (1 - (coalesce(high, 0) - coalesce(low, 0)) / 100.0::DOUBLE) * 40')} AS i0,
    coalesce(searched, 0) AS interest, coalesce(n_products, 0) AS products, coalesce(promo_depth, 0) AS depth FROM v_signal)""")


def demand_scores(s: DataFrame) -> DataFrame:
    """Signals with momentum, shelf gap, phantom distribution, intent and the composite."""
    c, zero, half = F.col, F.lit(0.0), F.lit(50.0)
    sought, on_shelf = F.coalesce("searched", zero), c("n_products").cast("double")
    search = F.coalesce("search_momentum", half)
    macro = (F.coalesce("cpi_score", half) + F.coalesce("ppi_score", half)) / 2
    momentum = F.when(c("macro"), clamp(search * 0.8 + macro * 0.2)).otherwise(clamp(search))
    gap = clamp(sought * F.try_divide(F.lit(T.shelf_full), F.coalesce(on_shelf, F.lit(1.0))))
    phantom = F.when(on_shelf.isNotNull(), clamp(sought * F.greatest(zero, 1 - on_shelf / T.shelf_full)))
    intent = clamp(F.coalesce("weeks", F.lit(0)) / T.weeks * 60 + (1 - (F.coalesce("high", zero) - F.coalesce("low", zero)) / 100) * 40)
    x = s.withColumns({"m0": momentum, "g0": gap, "p0": phantom, "i0": intent})
    whole = clamp(0.25 * c("m0") + 0.40 * c("g0") + 0.15 * F.coalesce("p0", zero) + 0.20 * c("i0"))
    return x.withColumns({
        "momentum": half_up(c("m0")), "shelf_gap": half_up(c("g0")), "phantom": half_up(c("p0")), "intent": half_up(c("i0")), "demand": half_up(whole),
        "interest": sought, "products": F.coalesce("n_products", F.lit(0)), "depth": F.coalesce("promo_depth", zero)}).drop("m0", "g0", "p0", "i0")


@mart("month", "store_id", "category")
def demand(spark, sf) -> DataFrame:
    return demand_scores(signals(spark, sf))


@query(f"SELECT signal_id, month, store_id, category, momentum, shelf_gap, phantom, intent, demand, products, {r('interest')} AS interest, {r('depth', 6)} AS promo_depth, CASE WHEN searched IS NULL THEN 'no search data' WHEN n_products IS NULL THEN 'no shelf data' ELSE 'measured' END AS note FROM v_demand")
def demand_gap(spark, sf):
    c = F.col
    note = first_match([(c("searched").isNull(), "no search data"), (c("n_products").isNull(), "no shelf data")], "measured")
    return demand(spark, sf).select(
        "signal_id", *KEYS, "momentum", "shelf_gap", "phantom", "intent", "demand", "products", half_up(c("interest")).alias("interest"), half_up(c("depth"), 6).alias("promo_depth"), note.alias("note"))


# --- shelf risk and margin ------------------------------------------------------------------------

view("v_lags", f"SELECT month AS lag_month, v AS lag_v, lag(v) OVER w AS ppi1, lag(v, 3) OVER w AS ppi3, lag(v, 6) OVER w AS ppi6 FROM v_trend WHERE series_id = '{PRODUCER}' WINDOW w AS (ORDER BY month)")
view("v_tolerant", f"""SELECT month, CASE WHEN d <= {T.stale_months} THEN ppi1 END AS ppi1, CASE WHEN d <= {T.stale_months} THEN ppi3 END AS ppi3, CASE WHEN d <= {T.stale_months} THEN ppi6 END AS ppi6, coalesce(d > {T.stale_months}, true) AS ppi_stale
  FROM (SELECT *, (year(month) * 12 + month(month)) - (year(lag_month) * 12 + month(lag_month)) AS d FROM v_months ASOF LEFT JOIN v_lags ON month >= lag_month)""")
view("v_sought", "SELECT month, category, lag(interest) OVER w AS i1, lag(interest, 2) OVER w AS i2, lag(interest, 3) OVER w AS i3 FROM (SELECT DISTINCT month, category, interest FROM v_demand) WINDOW w AS (PARTITION BY category ORDER BY month)")
view("v_rival", f"SELECT category, month, avg(list_price) AS rival_mean, count(DISTINCT store_id % {RIVAL_STORES}) AS rival_stores FROM v_retail WHERE flag = 'R' AND list_price > 0 GROUP BY ALL")
view("v_based", """SELECT *, (ppi - coalesce(ppi1, ppi)) / nullif(coalesce(ppi1, ppi), 0) * 100 AS ppi_rise, (retail - coalesce(retail1, retail)) / nullif(coalesce(retail1, retail), 0) * 100 AS retail_rise
  FROM (SELECT *, lag(retail) OVER w AS retail1, lag(retail, 3) OVER w AS retail3, lag(retail, 6) OVER w AS retail6 FROM v_demand WINDOW w AS (PARTITION BY store_id, category ORDER BY month))
  JOIN v_tolerant USING (month) JOIN v_sought USING (month, category) LEFT JOIN v_rival USING (month, category)""")
_UP = f"ppi_rise > {T.index_flat}"
view("v_risk", f"""SELECT * EXCLUDE (a0, d0, t0, c0, b0, x0, k0, m0, o0), {r('a0')} AS missed, {r('d0')} AS decay, {r('t0')} AS thin, {r('c0')} AS threat, {r('b0')} AS trap,
  {r(cl('0.30 * a0 + 0.25 * d0 + 0.15 * t0 + 0.20 * c0 + 0.10 * b0'))} AS shelf_risk, {r('x0')} AS place, {r('k0')} AS cost_shock, {r('m0')} AS margin, {r('o0')} AS promo_risk,
  {r(cl('0.40 * m0 + 0.25 * k0 + 0.20 * o0 + 0.15 * (100 - x0)'))} AS margin_risk FROM (SELECT *,
    {cl('0.7 * shelf_gap + CASE WHEN interest > 60 AND products < 10 THEN 30 WHEN interest > 40 AND products < 20 THEN 15 ELSE 0 END')} AS a0,
    {cl('CASE WHEN interest >= coalesce(i1, 100) THEN greatest(0.0, 50 - (interest - coalesce(i1, 50)) / 5.0::DOUBLE) WHEN coalesce(i1, 100) >= coalesce(i2, 100) THEN 35.0::DOUBLE WHEN coalesce(i2, 100) >= coalesce(i3, 100) THEN 60.0::DOUBLE ELSE 85.0::DOUBLE END')} AS d0,
    {cl('products / 50.0::DOUBLE * 100 * greatest(0.0, 1 - interest / 100.0::DOUBLE)')} AS t0,
    {cl(f'''CASE WHEN retail > rival_mean THEN least(100.0::DOUBLE, 50 + (retail - rival_mean) / rival_mean * 200) WHEN retail <= rival_mean THEN greatest(0.0::DOUBLE, 25 - (rival_mean - retail) / rival_mean * 100)
      WHEN retail IS NULL OR retail1 IS NULL OR ppi1 IS NULL THEN 25.0::DOUBLE WHEN retail < retail1 AND {_UP} THEN 80.0::DOUBLE WHEN retail < retail1 THEN 50.0::DOUBLE WHEN {_UP} THEN 35.0::DOUBLE ELSE 15.0::DOUBLE END''')} AS c0,
    {cl('depth * 2 + CASE WHEN products > 0 AND depth > 15 THEN 20 ELSE 0 END')} AS b0,
    {cl(f'CASE WHEN retail IS NULL THEN 50.0::DOUBLE WHEN cpi IS NOT NULL THEN retail / {T.price_unit}::DOUBLE * 100 / nullif(cpi / 2.6::DOUBLE, 0) END')} AS x0,
    {cl('(ppi - coalesce(ppi3, ppi)) / nullif(coalesce(ppi3, 100), 0) * 500')} AS k0,
    {cl(f'''CASE WHEN retail IS NULL THEN 30.0::DOUBLE WHEN ppi IS NULL THEN NULL WHEN retail1 IS NULL OR ppi1 IS NULL THEN 50.0::DOUBLE WHEN retail <= retail1 AND {_UP} THEN 80.0::DOUBLE WHEN retail <= retail1 THEN 55.0::DOUBLE
      WHEN {_UP} THEN 40.0::DOUBLE ELSE greatest(0.0::DOUBLE, 30 - retail_rise * {T.healthy_per_pct}::DOUBLE) END''')} AS m0,
    {cl('coalesce(n_promo / nullif(n_items, 0)::DOUBLE, 0) * 80 + depth')} AS o0,
    {r('coalesce((coalesce(retail, 0) - coalesce(retail3, retail, 0)) / nullif(abs(coalesce(ppi, 0) - coalesce(ppi3, ppi, 0)), 0) * 100, 0)')} AS passthrough FROM v_based)""")


def index_lags(spark, sf, months: DataFrame) -> DataFrame:
    """months with the lags of the producer index, taken from a row that is not too old; tables of one row a month."""
    w = Window.orderBy("lag_month")
    x = index(spark, sf, PRODUCER, "lag_v").withColumnRenamed("month", "lag_month").withColumns({f"ppi{k}": F.lag("lag_v", k).over(w) for k in (1, 3, 6)})
    j = asof(months, x.drop("lag_v"), "month", "lag_month", [], ["ppi1", "ppi3", "ppi6"])
    d = months_between_starts(F.col("month"), F.col("lag_month"))
    return j.select("month", *[F.when(d <= T.stale_months, F.col(k)).alias(k) for k in ("ppi1", "ppi3", "ppi6")], F.coalesce(d > T.stale_months, F.lit(True)).alias("ppi_stale"))


def rival_means(cells: DataFrame, per_category: bool = True) -> DataFrame:
    """The competitor's mean price by month and category, or by month alone."""
    x = cells.withColumnRenamed("pulled", "month")
    if per_category:
        return x.select("month", "category", "rival_mean", "rival_stores")
    mean = F.try_divide(F.sum(F.col("rival_mean") * F.col("rival_n")), F.sum("rival_n"))
    return x.groupBy("month").agg(mean.alias("rival_mean"), F.max("rival_stores").alias("rival_stores"))


def based(d: DataFrame, lags: DataFrame, rivals: DataFrame) -> DataFrame:
    """Demand with the lags of price, interest and index, and the competitor's price."""
    c = F.col
    w = Window.partitionBy("store_id", "category").orderBy("month")
    # one row a month and category
    terms = d.select("month", "category", "interest").distinct()
    by = Window.partitionBy("category").orderBy("month")
    terms = terms.select("month", "category", *[F.lag("interest", k).over(by).alias(f"i{k}") for k in (1, 2, 3)])
    x = d.withColumns({f"retail{k}": F.lag("retail", k).over(w) for k in (1, 3, 6)})
    x = x.join(F.broadcast(lags), "month").join(terms, ["month", "category"]).join(rivals, [k for k in ("month", "category") if k in rivals.columns], "left")
    return x.withColumns({"ppi_rise": pct_change(c("ppi"), F.coalesce("ppi1", "ppi")), "retail_rise": pct_change(c("retail"), F.coalesce("retail1", "retail"))})


def margin_pressure(retail: Column, before: Column, ppi: Column, ppi_before: Column, ppi_rise: Column, retail_rise: Column) -> Column:
    """Ordered: what the price did against what the producer index did."""
    up = ppi_rise > T.index_flat
    healthy = F.greatest(F.lit(0.0), 30 - retail_rise * T.healthy_per_pct)
    return (
        F.when(retail.isNull(), 30.0).when(ppi.isNull(), None).when(before.isNull() | ppi_before.isNull(), 50.0).when((retail <= before) & up, 80.0)
        .when(retail <= before, 55.0).when(up, 40.0).otherwise(healthy))


def risks(x: DataFrame) -> DataFrame:
    """based() with the five risks of a shelf, the four of a margin, and their composites."""
    c, zero, half = F.col, F.lit(0.0), F.lit(50.0)
    was = {k: F.coalesce(f"i{k}", F.lit(100.0)) for k in (1, 2, 3)}
    falls = [c("interest") < was[1], was[1] < was[2], was[2] < was[3]]
    drift = F.greatest(zero, 50 - (c("interest") - F.coalesce("i1", half)) / 5)
    over = F.try_divide(c("retail") - c("rival_mean"), c("rival_mean"))
    up, cut = c("ppi_rise") > T.index_flat, c("retail") < c("retail1")
    guessed = first_match([(c("retail").isNull() | c("retail1").isNull() | c("ppi1").isNull(), 25.0), (cut & up, 80.0), (cut, 50.0), (up, 35.0)], 15.0)
    moved = F.abs(F.coalesce("ppi", zero) - F.coalesce("ppi3", "ppi", zero))
    shelf = {
        "a0": 0.7 * c("shelf_gap") + first_match([((c("interest") > 60) & (c("products") < 10), 30.0), ((c("interest") > 40) & (c("products") < 20), 15.0)], 0.0),
        "d0": F.when(falls[0] & falls[1] & falls[2], 85.0).when(falls[0] & falls[1], 60.0).when(falls[0], 35.0).otherwise(drift),
        "t0": c("products") / 50 * 100 * F.greatest(zero, 1 - c("interest") / 100),
        "c0": F.when(c("retail") > c("rival_mean"), F.least(F.lit(100.0), 50 + over * 200)).when(c("retail") <= c("rival_mean"), F.greatest(zero, 25 + over * 100)).otherwise(guessed),
        "b0": c("depth") * 2 + F.when((c("products") > 0) & (c("depth") > 15), 20.0).otherwise(0.0)}
    margin = {
        "x0": F.when(c("retail").isNull(), 50.0).when(c("cpi").isNotNull(), F.try_divide(c("retail") / T.price_unit * 100, c("cpi") / 2.6)),
        "k0": F.try_divide(c("ppi") - F.coalesce("ppi3", "ppi"), F.coalesce("ppi3", F.lit(100.0))) * 500,
        "m0": margin_pressure(c("retail"), c("retail1"), c("ppi"), c("ppi1"), c("ppi_rise"), c("retail_rise")),
        "o0": F.coalesce(F.try_divide(c("n_promo").cast("double"), c("n_items").cast("double")), zero) * 80 + c("depth")}
    names = {"a0": "missed", "d0": "decay", "t0": "thin", "c0": "threat", "b0": "trap", "x0": "place", "k0": "cost_shock", "m0": "margin", "o0": "promo_risk"}
    x = x.withColumns({k: clamp(e) for k, e in (shelf | margin).items()})
    x = x.withColumns({name: half_up(c(k)) for k, name in names.items()} | {
        "shelf_risk": half_up(clamp(0.30 * c("a0") + 0.25 * c("d0") + 0.15 * c("t0") + 0.20 * c("c0") + 0.10 * c("b0"))),
        "margin_risk": half_up(clamp(0.40 * c("m0") + 0.25 * c("k0") + 0.20 * c("o0") + 0.15 * (100 - c("x0")))),
        "passthrough": half_up(F.coalesce(F.try_divide(F.coalesce("retail", zero) - F.coalesce("retail3", "retail", zero), moved) * 100, zero))}).drop(*names)
    return x.withColumn("risk_level", first_match([(c("shelf_risk") >= 65, "HIGH"), (c("shelf_risk") >= 35, "MEDIUM")], "LOW"))


@mart("month", "store_id", "category")
def risk(spark, sf) -> DataFrame:
    d = demand(spark, sf)
    return risks(based(d, index_lags(spark, sf, d.select("month").distinct()), rival_means(rival_prices(spark, sf))))


@query(f"SELECT month, store_id, category, missed, decay, thin, threat, trap, shelf_risk, CASE WHEN shelf_risk >= 65 THEN 'HIGH' WHEN shelf_risk >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, {r('(retail - coalesce(rival_mean, retail)) / nullif(coalesce(rival_mean, retail), 0) * 100')} AS rival_advantage, CASE WHEN rival_mean IS NOT NULL THEN 'MEASURED' ELSE 'PROXY' END AS signal_type FROM v_risk")
def shelf_risk(spark, sf):
    c = F.col
    against = F.coalesce("rival_mean", "retail")
    return risk(spark, sf).select(
        *KEYS, "missed", "decay", "thin", "threat", "trap", "shelf_risk", "risk_level", half_up(pct_change(c("retail"), against)).alias("rival_advantage"),
        F.when(c("rival_mean").isNotNull(), "MEASURED").otherwise("PROXY").alias("signal_type"))


_MARGIN_OUT = ["place", "cost_shock", "margin", "promo_risk", "passthrough", "margin_risk", "ppi_stale"]


@query(f"SELECT month, store_id, category, {', '.join(_MARGIN_OUT)}, {r('retail1')} AS price_1m_ago, {r('retail6')} AS price_6m_ago, {r('ppi6')} AS ppi_6m_ago, retail1 IS NOT NULL AS has_prior_price, ppi1 IS NOT NULL AS has_prior_index FROM v_risk")
def price_margin(spark, sf):
    c = F.col
    return risk(spark, sf).select(
        *KEYS, *_MARGIN_OUT, half_up(c("retail1")).alias("price_1m_ago"), half_up(c("retail6")).alias("price_6m_ago"), half_up(c("ppi6")).alias("ppi_6m_ago"),
        c("retail1").isNotNull().alias("has_prior_price"), c("ppi1").isNotNull().alias("has_prior_index"))


# --- confidence -----------------------------------------------------------------------------------

#: Hours up to which a source counts as fresh and as usable, and its weight; search terms are collected once and do not age.
RECENCY = {"retail": (48, 168, 0.3125), "producer": (1080, 2160, 0.25), "consumer": (1080, 2160, 0.25), "rival": (336, 720, 0.1875)}
#: Hours after which the reasons name a source as stale.
STALE = {"retail": 168, "terms": 720, "rival": 336}

view("v_collected", f"""SELECT *, greatest(retail, producer, consumer, rival) + INTERVAL 1 DAY AS as_of FROM (SELECT max(l_shipdate) AS retail, max(l_shipdate) FILTER (l_returnflag = 'R') AS rival FROM lineitem),
  (SELECT max(o_orderdate) FILTER (o_orderpriority = '{PRODUCER}') AS producer, max(o_orderdate) FILTER (o_orderpriority = '{CONSUMER}') AS consumer FROM orders), (SELECT max(ts) AS terms FROM events)""")
view("v_hours", "SELECT " + ", ".join(f"date_sub('hour', {k}, as_of) AS {k}_hours" for k in ("retail", "producer", "consumer", "rival", "terms")) + " FROM v_collected")
view("v_conf", f"""SELECT *, {r(cl('0.30 * completeness + 0.25 * agreement + 0.20 * recency + 0.25 * coverage'))} AS confidence FROM (SELECT *, 20.0::DOUBLE * known AS completeness FROM (SELECT *,
    (interest > 0)::INT + (retail IS NOT NULL)::INT + (ppi IS NOT NULL)::INT + (cpi IS NOT NULL)::INT + (rival_mean IS NOT NULL)::INT AS known,
    CASE WHEN demand >= 50 AND shelf_risk >= 40 THEN 85 WHEN demand >= 30 AND shelf_risk >= 25 THEN 65 WHEN abs(demand - (100 - shelf_risk)) > 50 THEN 35 ELSE 50 END::DOUBLE AS agreement,
    {r(' + '.join(f"CASE WHEN {k}_hours IS NULL THEN 0 WHEN {k}_hours <= {a} THEN 100 WHEN {k}_hours <= {b} THEN 70 ELSE 30 END * {w}::DOUBLE" for k, (a, b, w) in RECENCY.items()))} AS recency,
    (35 * (retail IS NOT NULL)::INT + 25 * (interest > 0)::INT + 25 * (ppi IS NOT NULL AND cpi IS NOT NULL)::INT + 15 * (rival_mean IS NOT NULL)::INT)::DOUBLE AS coverage FROM v_risk, v_hours))""")


def hours_ago(last: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row: whole hours since each source was last collected; the clock is as_of, or a day after the latest collection that ages."""
    if as_of is None:
        as_of = F.greatest(*RECENCY) + F.expr("INTERVAL 1 DAY")
    return last.select(*[F.timestamp_diff("HOUR", F.col(k).cast("timestamp_ntz"), as_of.cast("timestamp_ntz")).alias(f"{k}_hours") for k in (*RECENCY, "terms")])


def confident(x: DataFrame, hours: DataFrame) -> DataFrame:
    """risks() with how far a signal can be trusted: complete, agreeing, recent and covered."""
    c = F.col
    has = lambda p: F.when(p, 1.0).otherwise(0.0)
    sought, priced, producer, consumer, rival = (has(c("interest") > 0), *(has(c(k).isNotNull()) for k in ("retail", "ppi", "cpi", "rival_mean")))
    fresh = lambda k, a, b: first_match([(c(f"{k}_hours").isNull(), 0.0), (c(f"{k}_hours") <= a, 100.0), (c(f"{k}_hours") <= b, 70.0)], 30.0)
    recency = sum((fresh(k, a, b) * w for k, (a, b, w) in RECENCY.items()), F.lit(0.0))
    x = x.crossJoin(F.broadcast(hours)).withColumns({  # one row
        "known": (sought + priced + producer + consumer + rival).cast("int"),
        "agreement": first_match([
            ((c("demand") >= 50) & (c("shelf_risk") >= 40), 85.0), ((c("demand") >= 30) & (c("shelf_risk") >= 25), 65.0),
            (F.abs(c("demand") - (100 - c("shelf_risk"))) > 50, 35.0)], 50.0),
        "recency": half_up(recency), "coverage": 35 * priced + 25 * sought + 25 * producer * consumer + 15 * rival})
    x = x.withColumn("completeness", 20.0 * c("known"))
    x = x.withColumn("confidence", half_up(clamp(0.30 * c("completeness") + 0.25 * c("agreement") + 0.20 * c("recency") + 0.25 * c("coverage"))))
    return x.withColumns({
        "confidence_level": first_match([(c("confidence") >= T.confidence_high, "HIGH"), (c("confidence") >= T.confidence_medium, "MEDIUM")], "LOW"), "reasons": codes(reasons())})


def reasons() -> list[tuple[Column, str]]:
    """The ordered reasons behind a signal's confidence."""
    c = F.col
    return [
        (F.coalesce("interest", F.lit(0.0)) == 0, "NO_SEARCH_SIGNAL"), (c("retail").isNull(), "NO_RETAIL_PRICE"), (c("ppi").isNull(), "NO_PPI_DATA"), (c("cpi").isNull(), "NO_CPI_DATA"),
        (c("rival_hours").isNull(), "NO_COMPETITOR_DATA"), (c("retail_hours") > STALE["retail"], "STALE_RETAIL"), (c("terms_hours") > STALE["terms"], "STALE_TRENDS"),
        (c("rival_hours") > STALE["rival"], "STALE_COMPETITOR"), (F.abs(c("demand") - (100 - c("shelf_risk"))) > 50, "SIGNAL_CONFLICT"), (c("known") == 5, "FULL_COVERAGE")]


_REASONS = f"""list_filter([CASE WHEN interest = 0 THEN 'NO_SEARCH_SIGNAL' END, CASE WHEN retail IS NULL THEN 'NO_RETAIL_PRICE' END, CASE WHEN ppi IS NULL THEN 'NO_PPI_DATA' END, CASE WHEN cpi IS NULL THEN 'NO_CPI_DATA' END,
  CASE WHEN rival_hours IS NULL THEN 'NO_COMPETITOR_DATA' END, CASE WHEN retail_hours > {STALE['retail']} THEN 'STALE_RETAIL' END, CASE WHEN terms_hours > {STALE['terms']} THEN 'STALE_TRENDS' END, CASE WHEN rival_hours > {STALE['rival']} THEN 'STALE_COMPETITOR' END,
  CASE WHEN abs(demand - (100 - shelf_risk)) > 50 THEN 'SIGNAL_CONFLICT' END, CASE WHEN known = 5 THEN 'FULL_COVERAGE' END], lambda x: x IS NOT NULL)::VARCHAR"""

# --- readiness ------------------------------------------------------------------------------------

view("v_ready", f"""SELECT *, {r(cl('0.35 * region0 + 0.30 * fit0 + 0.20 * (100 - shelf_risk) + 0.15 * confidence'))} AS ready, {r('region0')} AS region, {r('fit0')} AS fit FROM (SELECT *,
    {cl('0.50 * demand + 0.30 * momentum + 0.20 * intent')} AS region0, {cl('0.40 * shelf_gap + 0.25 * place + 0.20 * (100 - margin) + 0.15 * (100 - promo_risk)')} AS fit0,
    CASE WHEN shelf_risk >= 65 THEN 'HIGH' WHEN shelf_risk >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, CASE WHEN confidence >= {T.confidence_high} THEN 'HIGH' WHEN confidence >= {T.confidence_medium} THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level FROM v_conf)""")


def readiness(x: DataFrame) -> DataFrame:
    """confident() with readiness for expansion (unknown where the margin side is) and what to do about it."""
    c = F.col
    x = x.withColumns({
        "region0": clamp(0.50 * c("demand") + 0.30 * c("momentum") + 0.20 * c("intent")),
        "fit0": clamp(0.40 * c("shelf_gap") + 0.25 * c("place") + 0.20 * (100 - c("margin")) + 0.15 * (100 - c("promo_risk")))})
    whole = clamp(0.35 * c("region0") + 0.30 * c("fit0") + 0.20 * (100 - c("shelf_risk")) + 0.15 * c("confidence"))
    return x.withColumns({"ready": half_up(whole), "region": half_up(c("region0")), "fit": half_up(c("fit0"))}).drop("region0", "fit0").withColumn("expansion", expansion_action())


def expansion_action() -> Column:
    c = F.col
    sound = c("margin") < T.margin_fix
    return first_match([
        ((c("ready") >= 70) & (c("confidence") >= 60) & sound, "PITCH NOW"), ((c("ready") >= 55) & (c("risk_level") == "LOW") & sound, "PREPARE PITCH"),
        ((c("ready") >= 55) & (c("risk_level") == "MEDIUM") & sound, "MONITOR AND PREPARE"), (c("decay") > 60, "DEFEND FIRST"), (c("shelf_risk") >= 65, "REMEDIATE RISK"),
        (c("confidence") < 40, "COLLECT MORE DATA"), (~c("macro"), "MARGIN UNKNOWN"), (c("margin") >= T.margin_fix, "FIX MARGINS"), (c("ready") >= 40, "BUILD CASE")], "WATCH AND WAIT")


@mart("month", "store_id", "category")
def ready(spark, sf) -> DataFrame:
    """All scores of all signals."""
    return readiness(confident(risk(spark, sf), hours_ago(collected(spark, sf))))


_CONFIDENCE_OUT = ["completeness", "agreement", "recency", "coverage", "confidence"]


@query(f"SELECT month, store_id, category, {', '.join(_CONFIDENCE_OUT)}, known AS source_count, confidence_level FROM v_ready")
def confidence_layer(spark, sf):
    return ready(spark, sf).select(*KEYS, *_CONFIDENCE_OUT, F.col("known").alias("source_count"), "confidence_level")


@query(f"SELECT {_REASONS} AS reason_codes, count(*) AS n, {r('avg(confidence)', 4)} AS confidence FROM v_conf GROUP BY ALL")
def reason_codes(spark, sf):
    """The ordered reasons, and how many signals share them."""
    return ready(spark, sf).groupBy(F.col("reasons").cast("string").alias("reason_codes")).agg(F.count("*").alias("n"), half_up(F.avg("confidence"), 4).alias("confidence"))


@query(f"""SELECT month, store_id, category, region, fit, ready, CASE WHEN ready >= 70 AND confidence >= 60 AND margin < {T.margin_fix} THEN 'PITCH NOW' WHEN ready >= 55 AND risk_level = 'LOW' AND margin < {T.margin_fix} THEN 'PREPARE PITCH'
  WHEN ready >= 55 AND risk_level = 'MEDIUM' AND margin < {T.margin_fix} THEN 'MONITOR AND PREPARE' WHEN decay > 60 THEN 'DEFEND FIRST' WHEN shelf_risk >= 65 THEN 'REMEDIATE RISK' WHEN confidence < 40 THEN 'COLLECT MORE DATA'
  WHEN NOT macro THEN 'MARGIN UNKNOWN' WHEN margin >= {T.margin_fix} THEN 'FIX MARGINS' WHEN ready >= 40 THEN 'BUILD CASE' ELSE 'WATCH AND WAIT' END AS action,
  'Score of ' || known::VARCHAR || ' of 5 sources; confidence ' || confidence_level || ', risk ' || risk_level AS note,
  CAST(row_number() OVER (PARTITION BY month ORDER BY ready DESC NULLS LAST, store_id, category) AS BIGINT) AS month_rank FROM v_ready""")
def expansion_readiness(spark, sf):
    c = F.col
    note = F.concat(F.lit("Score of "), c("known").cast("string"), F.lit(" of 5 sources; confidence "), "confidence_level", F.lit(", risk "), "risk_level")
    ranked = numbered_within(ready(spark, sf), ["month"], [c("ready").isNull(), -c("ready"), c("store_id"), c("category")], "month_rank")
    return ranked.select(*KEYS, "region", "fit", "ready", c("expansion").alias("action"), note.alias("note"), "month_rank")
