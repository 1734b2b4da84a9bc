"""The single operators that the marts are made of: projections, joins, aggregates, windows and as-of joins on the conformed inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.config import T
from gondola.functions.exprs import first_match, half_up, looked_up, months_between_starts
from gondola.operators.joins import asof
from gondola.operators.windows import numbered_within, tile
from gondola.plans.registry import query, r, view
from gondola.sources.tables import PARENT, PRODUCER, SHELF, STORES, conformed, interest, producer_index, table

view("v_retail", f"""SELECT l_suppkey % {STORES} AS store_id, p_type AS category, l_partkey AS product_id, p_name AS description,
  CAST(l_shipdate AS DATE) AS day, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_extendedprice / l_quantity AS price,
  CASE WHEN l_discount >= 0.05 THEN l_extendedprice / l_quantity * (1 - l_discount) END AS promo, p_retailprice AS list_price, l_returnflag AS flag
  FROM lineitem JOIN part ON l_partkey = p_partkey""")
view("v_index", "SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS value FROM orders GROUP BY ALL")
view("v_interest", "SELECT event_type AS category, CAST(ts AS DATE) AS day, avg(value) AS interest FROM events GROUP BY ALL")
view("v_months", "SELECT DISTINCT month FROM v_retail")


def sql_lookup(column: str, found: dict, default: str) -> str:
    """SQL of looked_up."""
    literal = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {literal(v)}" for k, v in found.items()) + f" ELSE {default} END"


# --- relational core ------------------------------------------------------------------------------


@query("SELECT month, category, count(*) AS n, count(DISTINCT product_id) AS products FROM v_retail WHERE price BETWEEN 500 AND 1500 AND category IS NOT NULL GROUP BY ALL")
def scan_filter_project(spark, sf):
    x = conformed(spark, sf).where(F.col("price").between(500, 1500) & F.col("category").isNotNull())
    return x.groupBy("month", "category").agg(F.count("*").alias("n"), F.count_distinct("product_id").alias("products"))


@query("SELECT series_id, month, doc FROM (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey AS doc, row_number() OVER (PARTITION BY o_orderpriority, date_trunc('month', o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def dedup_latest(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id"), F.trunc(F.to_date("o_orderdate"), "MONTH").alias("month"), "o_orderdate", F.col("o_orderkey").alias("doc"))
    # the latest of a group by one aggregate: no sort of the rows
    return o.groupBy("series_id", "month").agg(F.max(F.struct("o_orderdate", "doc")).alias("m")).select("series_id", "month", F.col("m.doc").alias("doc"))


@query("SELECT DISTINCT md5(CAST(month AS VARCHAR) || '||' || CAST(store_id AS VARCHAR) || '||' || category) AS signal_id, month, store_id, category FROM v_retail")
def surrogate_keys(spark, sf):
    x = conformed(spark, sf).select("month", "store_id", "category").distinct()
    return x.withColumn("signal_id", F.md5(F.concat_ws("||", F.col("month").cast("string"), F.col("store_id").cast("string"), "category")))


@query("SELECT product_id, category, first_day FROM (SELECT product_id, category, day AS first_day, row_number() OVER (PARTITION BY product_id ORDER BY day, store_id) AS k FROM v_retail) WHERE k = 1")
def keep_first(spark, sf):
    """One row a product, the earliest: what drop_duplicates keeps, made definite."""
    first = conformed(spark, sf).groupBy("product_id").agg(F.min(F.struct("day", "store_id", "category")).alias("m"))
    return first.select("product_id", F.col("m.category").alias("category"), F.col("m.day").alias("first_day"))


@query("SELECT category, product_id, turnover, CAST(k AS BIGINT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY turnover DESC, product_id) AS k FROM (SELECT category, product_id, " + r("sum(price)") + " AS turnover FROM v_retail GROUP BY ALL)) WHERE k <= 5")
def top_per_group(spark, sf):
    """The five products of each category with the highest turnover."""
    x = conformed(spark, sf).groupBy("category", "product_id").agg(half_up(F.sum("price")).alias("turnover"))
    w = Window.partitionBy("category").orderBy(F.desc("turnover"), "product_id")
    return x.withColumn("k", F.row_number().over(w).cast("long")).where("k <= 5")


@query("SELECT vec_id, label FROM embeddings ORDER BY md5('42' || vec_id::VARCHAR), vec_id LIMIT 20")
def seeded_sample(spark, sf):
    """A sample for plots: the rows of smallest digest, the same in every run with a seed."""
    return table(spark, sf, "embeddings").orderBy(F.md5(F.concat(F.lit("42"), F.col("vec_id").cast("string")).cast("binary")), "vec_id").limit(20).select("vec_id", "label")


@query("SELECT event_type, count(*) AS n, count(k) AS known, " + r("avg(k)", 4) + " AS k_mean, max(k) AS k_max FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def event_json_extract(spark, sf):
    """Fields of JSON text by a fixed schema; malformed text gives null."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("k").alias("known"), half_up(F.avg("k"), 4).alias("k_mean"), F.max("k").alias("k_max"))


@query("""SELECT d AS date_day, md5(d::VARCHAR) AS date_key, year(d) AS year, quarter(d) AS quarter, month(d) AS month, weekofyear(d) AS iso_week, dayofweek(d) + 1 AS day_of_week, last_day(d) = d AS is_month_end
FROM (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS d FROM v_retail)""")
def dim_date_spine(spark, sf):
    ends = conformed(spark, sf).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    d = ends.select(F.explode(F.sequence("a", "b")).alias("date_day"))
    c = F.col("date_day")
    return d.select(c, F.md5(c.cast("string").cast("binary")).alias("date_key"), F.year(c).cast("long").alias("year"), F.quarter(c).cast("long").alias("quarter"), F.month(c).cast("long").alias("month"), F.weekofyear(c).cast("long").alias("iso_week"), F.dayofweek(c).cast("long").alias("day_of_week"), (F.last_day(c) == c).alias("is_month_end"))


view("v_category", f"SELECT md5(category) AS category_key, category, {sql_lookup('category', {k: PARENT[v] for k, v in SHELF.items()}, chr(39) + 'General' + chr(39))} AS parent FROM (SELECT DISTINCT coalesce(category, 'Unknown') AS category FROM v_retail)")
view("v_location", """SELECT md5(store_id::VARCHAR) AS location_key, store_id, 'Store ' || coalesce(city || ' - ' || label, store_id::VARCHAR) AS store_name,
  coalesce(city, store_id::VARCHAR) AS city, 'TX' AS state, 'South' AS region FROM (SELECT DISTINCT store_id FROM v_retail WHERE store_id IS NOT NULL)
  LEFT JOIN (SELECT s_suppkey, s_name AS label, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON s_suppkey = store_id""")


@query("SELECT * FROM v_category")
def dim_category(spark, sf):
    x = conformed(spark, sf).select(F.coalesce("category", F.lit("Unknown")).alias("category")).distinct()
    return x.select(F.md5(F.col("category").cast("binary")).alias("category_key"), "category", looked_up(F.col("category"), {k: PARENT[v] for k, v in SHELF.items()}, "General").alias("parent"))


def store_labels(spark, sf):
    """(store_id, label) of each listed store: its label is "city - branch"."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("store_id"), F.concat_ws(" - ", "n_name", "s_name").alias("label"))


@query("SELECT * FROM v_location")
def dim_location(spark, sf):
    """Stores with their label, "city - branch", and the city out of it; a store without a label goes by its id."""
    stores = conformed(spark, sf).where("store_id is not null").select("store_id").distinct()
    key = F.col("store_id").cast("string")
    label = F.coalesce("label", key)
    return stores.join(store_labels(spark, sf), "store_id", "left").select(
        F.md5(key.cast("binary")).alias("location_key"), "store_id", F.concat(F.lit("Store "), label).alias("store_name"),
        F.get(F.split(label, " - "), F.lit(0)).alias("city"), F.lit("TX").alias("state"), F.lit("South").alias("region"))


#: The sources, their kind and how often they are collected.
SOURCES = [("retail", "Retail Price", "Daily"), ("producer", "Producer Price Index", "Monthly"), ("consumer", "Consumer Price Index", "Monthly"),
           ("terms", "Search Trends", "Weekly"), ("rival", "Competitor Intelligence", "Weekly")]


@query("SELECT md5(source_name) AS source_key, source_name, source_type, refresh_frequency FROM (VALUES " + ", ".join(map(str, SOURCES)) + ") t(source_name, source_type, refresh_frequency)")
def dim_source(spark, sf):
    """A static table: an array of structs, inlined into rows."""
    rows = F.array(*[F.struct(F.lit(a).alias("source_name"), F.lit(b).alias("source_type"), F.lit(c).alias("refresh_frequency")) for a, b, c in SOURCES])
    return spark.range(1).select(F.inline(rows)).select(F.md5(F.col("source_name").cast("binary")).alias("source_key"), "source_name", "source_type", "refresh_frequency")


@query("SELECT c.category, c.parent, l.store_id, l.store_name, l.city FROM v_category c CROSS JOIN v_location l")
def dims_crossed(spark, sf):
    """All categories in all stores: both are dimensions."""
    return dim_category(spark, sf).select("category", "parent").crossJoin(dim_location(spark, sf).select("store_id", "store_name", "city"))


@query(f"""SELECT m.month, s.store_id, s.category, count(v_retail.price) AS n, {r("avg(v_retail.price)")} AS avg_price FROM v_months m CROSS JOIN (SELECT DISTINCT store_id, category FROM v_retail) s
  LEFT JOIN v_retail ON v_retail.month = m.month AND v_retail.store_id = s.store_id AND v_retail.category = s.category GROUP BY ALL""")
def cross_spine(spark, sf):
    x = conformed(spark, sf).groupBy("month", "store_id", "category").agg(F.count("price").alias("n"), F.avg("price").alias("p"))
    # months x segments: both sides are keys of an aggregate, and months are few
    spine = F.broadcast(x.select("month").distinct()).crossJoin(x.select("store_id", "category").distinct())
    return spine.join(x, ["month", "store_id", "category"], "left").select("month", "store_id", "category", F.coalesce("n", F.lit(0)).alias("n"), half_up(F.col("p")).alias("avg_price"))


@query(f"SELECT store_id, count(*) AS n FROM v_retail WHERE day IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '{PRODUCER}') GROUP BY store_id")
def semi_join_dates(spark, sf):
    days = table(spark, sf, "orders").where(F.col("o_orderpriority") == PRODUCER).select(F.to_date("o_orderdate").alias("day"))
    return conformed(spark, sf).join(days, "day", "left_semi").groupBy("store_id").agg(F.count("*").alias("n"))


@query(f"SELECT s.series_id, s.month, {r('s.value - m.value')} AS above FROM v_index s LEFT JOIN (SELECT value FROM v_index WHERE series_id = '{PRODUCER}' ORDER BY month DESC LIMIT 1) m ON true")
def latest_onto_all(spark, sf):
    """The latest row of one series beside all rows; without one, nulls."""
    x = producer_index(spark, sf)
    last = x.where(F.col("series_id") == PRODUCER).orderBy(F.desc("month")).limit(1).agg(F.max("value").alias("last"))  # one row, even without any
    return x.crossJoin(F.broadcast(last)).select("series_id", "month", half_up(F.col("value") - F.col("last")).alias("above"))


@query(f"SELECT category, month, {r('stddev_samp(price) / nullif(avg(price), 0) * 100', 1)} AS cv, count(DISTINCT CASE WHEN promo IS NOT NULL THEN product_id END) AS promoted, {r('count_if(promo IS NOT NULL) / nullif(count(*), 0)::DOUBLE * 100')} AS promo_share, {r('avg((price - coalesce(promo, price)) / nullif(price, 0)) * 100', 6)} AS promo_depth FROM v_retail GROUP BY ALL")
def category_cv(spark, sf):
    depth = F.try_divide(F.col("price") - F.coalesce("promo", "price"), F.col("price"))
    return conformed(spark, sf).groupBy("category", "month").agg(
        half_up(F.try_divide(F.stddev_samp("price"), F.avg("price")) * 100, 1).alias("cv"),
        F.count_distinct(F.when(F.col("promo").isNotNull(), F.col("product_id"))).alias("promoted"),
        half_up(F.try_divide(F.count_if(F.col("promo").isNotNull()).cast("double"), F.count("*").cast("double")) * 100).alias("promo_share"),
        half_up(F.avg(depth) * 100, 6).alias("promo_depth"))


@query(f"SELECT category, month, {r('avg(n)')} AS products_per_store FROM (SELECT category, month, store_id, count(DISTINCT product_id) AS n FROM v_retail GROUP BY ALL) GROUP BY ALL")
def two_level_count(spark, sf):
    per = conformed(spark, sf).groupBy("category", "month", "store_id").agg(F.count_distinct("product_id").alias("n"))
    return per.groupBy("category", "month").agg(half_up(F.avg("n")).alias("products_per_store"))


@query("SELECT store_id, category AS top_category, n FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY n DESC, category) AS k FROM (SELECT store_id, category, count(*) AS n FROM v_retail GROUP BY ALL)) WHERE k = 1")
def approx_mode(spark, sf):
    n = conformed(spark, sf).groupBy("store_id", "category").agg(F.count("*").alias("n"))
    return n.groupBy("store_id").agg(F.min_by(F.struct("category", "n"), F.struct(-F.col("n"), "category")).alias("m")).select("store_id", F.col("m.category").alias("top_category"), F.col("m.n").alias("n"))


@query("SELECT CAST(max(CASE WHEN s = 'orders' THEN d END) AS DATE) AS orders, CAST(max(CASE WHEN s = 'lineitem' THEN d END) AS DATE) AS lineitem, CAST(max(CASE WHEN s = 'events' THEN d END) AS DATE) AS events FROM (SELECT 'orders' AS s, max(o_orderdate) AS d FROM orders UNION ALL SELECT 'lineitem', max(l_shipdate) FROM lineitem UNION ALL SELECT 'events', max(ts) FROM events)")
def cond_pivot_freshness(spark, sf):
    latest = lambda t, c: table(spark, sf, t).agg(F.max(c).alias("d")).select(F.lit(t).alias("s"), "d")
    x = latest("orders", "o_orderdate").unionByName(latest("lineitem", "l_shipdate")).unionByName(latest("events", "ts"))
    return x.agg(*[F.to_date(F.max(F.when(F.col("s") == t, F.col("d")))).alias(t) for t in ("orders", "lineitem", "events")])


@query("SELECT category, count(*) AS items, count(DISTINCT product_id) AS products, any_value(parent) AS parent, " + ", ".join(r(f"{f}(price)", 4) + f" AS {n}" for n, f in (("low", "min"), ("mean", "avg"), ("high", "max"), ("noise", "stddev_samp"))) + " FROM v_retail JOIN v_category USING (category) GROUP BY category")
def describe_prices(spark, sf):
    """Count, distinct count, least, mean, greatest and deviation of prices by category; any_value skips nulls."""
    f = F.col("price")
    x = conformed(spark, sf).join(F.broadcast(dim_category(spark, sf).select("category", "parent")), "category")  # one row a category
    return x.groupBy("category").agg(
        F.count("*").alias("items"), F.count_distinct("product_id").alias("products"), F.any_value("parent", True).alias("parent"),
        *[half_up(g(f), 4).alias(n) for n, g in (("low", F.min), ("mean", F.avg), ("high", F.max), ("noise", F.stddev_samp))])


# --- windows --------------------------------------------------------------------------------------


@query(f"""SELECT category, month, {r('p')} AS price, CAST(CASE WHEN p < a AND a < b AND b < c3 THEN 85 WHEN p < a AND a < b THEN 60 WHEN p < a THEN 35 ELSE 0 END AS BIGINT) AS decay
FROM (SELECT *, lag(p) OVER w AS a, lag(p, 2) OVER w AS b, lag(p, 3) OVER w AS c3 FROM (SELECT category, month, avg(price) AS p FROM v_retail GROUP BY ALL) WINDOW w AS (PARTITION BY category ORDER BY month))""")
def monotone_decline(spark, sf):
    w = Window.partitionBy("category").orderBy("month")
    x = conformed(spark, sf).groupBy("category", "month").agg(F.avg("price").alias("p"))
    x = x.withColumns({"a": F.lag("p").over(w), "b": F.lag("p", 2).over(w), "c": F.lag("p", 3).over(w)})
    one, two, three = F.col("p") < F.col("a"), F.col("a") < F.col("b"), F.col("b") < F.col("c")
    return x.select("category", "month", half_up(F.col("p")).alias("price"), first_match([(one & two & three, 85), (one & two, 60), (one, 35)], 0).cast("long").alias("decay"))


@query(f"""SELECT month, store_id, category, CAST(ntile(3) OVER (PARTITION BY category, month ORDER BY {r('p')} NULLS LAST, store_id) AS BIGINT) AS tier, CAST(row_number() OVER (PARTITION BY month ORDER BY {r('p')} DESC, store_id, category) AS BIGINT) AS month_rank
FROM (SELECT month, store_id, category, avg(price) AS p FROM v_retail GROUP BY ALL)""")
def ntile_peers(spark, sf):
    x = conformed(spark, sf).groupBy("month", "store_id", "category").agg(half_up(F.avg("price")).alias("p"))
    x = numbered_within(x, ["category", "month"], [F.col("p").isNull(), F.col("p"), F.col("store_id")], "place")
    x = numbered_within(x, ["month"], [F.col("p").isNull(), -F.col("p"), F.col("store_id"), F.col("category")], "month_rank")
    return x.select("month", "store_id", "category", tile(F.col("place"), F.col("place_of"), 3).alias("tier"), "month_rank")


@query(f"SELECT category, day, {r('interest')} AS interest, CASE WHEN interest > m + d THEN 'Possible Seasonal Spike' ELSE 'Normal' END AS flag FROM (SELECT *, avg(interest) OVER (PARTITION BY category) AS m, stddev_samp(interest) OVER (PARTITION BY category) AS d FROM v_interest) ORDER BY category, day")
def spike_flag(spark, sf):
    w = Window.partitionBy("category")
    i = F.col("interest")
    flag = F.when(i > F.avg(i).over(w) + F.stddev_samp(i).over(w), "Possible Seasonal Spike").otherwise("Normal")
    return interest(spark, sf).select("category", "day", half_up(i).alias("interest"), flag.alias("flag")).orderBy("category", "day")


@query(f"""SELECT category, day, {', '.join(f"{r(f'lag(interest, {k}) OVER w')} AS lag{k}" for k in (1, 2, 4, 8))}, {r('lead(interest, 4) OVER w')} AS lead4,
  CASE WHEN count(interest) OVER a >= 2 THEN {r('avg(interest) OVER a')} END AS mean4, CASE WHEN count(interest) OVER a >= 2 THEN {r('stddev_samp(interest) OVER a')} END AS noise4,
  CAST(weekofyear(day) AS BIGINT) AS week FROM v_interest WINDOW w AS (PARTITION BY category ORDER BY day), a AS (PARTITION BY category ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def lag_features(spark, sf):
    """Lags, a lead, and rolling mean and deviation over four rows with two at least."""
    w = Window.partitionBy("category").orderBy("day")
    a, i = w.rowsBetween(-3, 0), F.col("interest")
    rolled = lambda f: F.when(F.count(i).over(a) >= 2, half_up(f(i).over(a)))
    return interest(spark, sf).select(
        "category", "day", *[half_up(F.lag(i, k).over(w)).alias(f"lag{k}") for k in (1, 2, 4, 8)], half_up(F.lead(i, 4).over(w)).alias("lead4"),
        rolled(F.avg).alias("mean4"), rolled(F.stddev_samp).alias("noise4"), F.weekofyear("day").cast("long").alias("week"))


# --- as-of joins ----------------------------------------------------------------------------------


def competitor_pulls(x: DataFrame) -> DataFrame:
    """All rows of the competitor feed; pulled is their month of collection."""
    return x.where(F.col("flag") == "R").withColumn("pulled", F.col("month"))


view("v_dates", "SELECT CAST(month + INTERVAL 20 DAY AS DATE) AS on_day FROM v_months")
view("v_dated", f"SELECT month AS m, value FROM v_index WHERE series_id = '{PRODUCER}'")


def _asof_inputs(spark, sf):
    s = conformed(spark, sf).select("month").distinct().select(F.date_add("month", 20).alias("on_day"))
    i = producer_index(spark, sf).where(F.col("series_id") == PRODUCER).select(F.col("month").alias("m"), "value")
    return s, i


@query(f"SELECT on_day, m AS index_month, {r('value')} AS value FROM v_dates ASOF LEFT JOIN v_dated ON on_day >= m")
def asof_month(spark, sf):
    s, i = _asof_inputs(spark, sf)
    return asof(s, i, "on_day", "m", [], ["value"]).select("on_day", F.col("m").alias("index_month"), half_up(F.col("value")).alias("value"))


@query(f"""SELECT on_day, CASE WHEN d <= {T.stale_months} THEN m END AS index_month, CASE WHEN d <= {T.stale_months} THEN {r('value')} END AS value, coalesce(d > {T.stale_months}, true) AS stale
FROM (SELECT on_day, m, value, (year(on_day) * 12 + month(on_day)) - (year(m) * 12 + month(m)) AS d FROM v_dates ASOF LEFT JOIN v_dated ON on_day >= m)""")
def asof_tolerance(spark, sf):
    s, i = _asof_inputs(spark, sf)
    j = asof(s, i, "on_day", "m", [], ["value"])
    d = months_between_starts(F.col("on_day"), F.col("m"))
    fresh = d <= T.stale_months
    return j.select("on_day", F.when(fresh, F.col("m")).alias("index_month"), F.when(fresh, half_up(F.col("value"))).alias("value"), F.coalesce(d > T.stale_months, F.lit(True)).alias("stale"))


@query(f"""SELECT s.category, s.month, pulled, {r('competitor')} AS competitor FROM (SELECT DISTINCT category, month FROM v_retail) s
ASOF JOIN (SELECT category, month AS pulled, avg(list_price) AS competitor FROM v_retail WHERE flag = 'R' GROUP BY ALL) c ON s.category = c.category AND s.month >= c.pulled""")
def asof_carry_forward(spark, sf):
    x = conformed(spark, sf)
    c = competitor_pulls(x).groupBy("category", "pulled").agg(F.avg("list_price").alias("competitor"))
    return asof(x.select("category", "month").distinct(), c, "month", "pulled", ["category"], ["competitor"]).where("pulled is not null").select("category", "month", "pulled", half_up(F.col("competitor")).alias("competitor"))
