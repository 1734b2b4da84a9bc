"""Is the data fit to be used?  Expectations, profiles, distributions, correlations, freshness and one score of it all."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.config import T
from gondola.functions.exprs import first_match, half_up
from gondola.operators.windows import average_rank
from gondola.plans.facts import signals
from gondola.plans.pricing import markdown_safety, pricing
from gondola.plans.registry import query, r, view
from gondola.plans.scores import ready, risk
from gondola.plans.serving import queue, scored
from gondola.sources.sinks import due_status
from gondola.sources.tables import PRODUCER, collected, conformed, producer_index, table

# --- expectations ---------------------------------------------------------------------------------

#: Fixed value: priced products that a category needs.
LEAST_PER_CATEGORY = 30


def violations(name: str, offenders: DataFrame) -> DataFrame:
    """(expectation, violations) of the rows that should not be there."""
    return offenders.agg(F.count("*").alias("violations")).select(F.lit(name).alias("expectation"), "violations")


def in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose known value lies outside; null is no breach."""
    return df.where(~F.col(column).between(low, high))


def accepted(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(~F.col(column).isin(*values))


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def only_if(total: Column) -> Column:
    """One row where a global count is above 0: HAVING without GROUP BY."""
    return total > 0


_SCORES = ["demand", "shelf_risk", "confidence", "ready", "margin_risk", "momentum", "intent"]
_ACTIONS = ["AVOID", "EXPAND", "DEFEND", "PITCH", "REPRICE", "CUTPROMO", "MONITOR", "INVESTIGATE"]
_SAFETY = "least(100, greatest(0, 100 - (margin * 0.45 + coalesce(promo_risk, 30) * 0.30 + coalesce(decay, 35) * 0.25)))"

_CHECKS = {
    "category_product_floor": f"SELECT category FROM v_retail WHERE price IS NOT NULL GROUP BY category HAVING count(*) < {LEAST_PER_CATEGORY}",
    "prior_coverage": "SELECT DISTINCT category FROM v_pricing WHERE prior = 50",
    "index_months_unique": "SELECT series_id, month FROM v_index GROUP BY ALL HAVING count(*) > 1",
    "margin_unknown_without_index": "SELECT count(*) FROM v_risk WHERE ppi IS NULL AND retail IS NOT NULL AND margin IS NOT NULL HAVING count(*) > 0",
    "shock_unknown_without_index": "SELECT count(*) FROM v_risk WHERE ppi IS NULL AND cost_shock IS NOT NULL HAVING count(*) > 0",
    "position_unknown_without_index": "SELECT count(*) FROM v_risk WHERE cpi IS NULL AND retail IS NOT NULL AND place IS NOT NULL HAVING count(*) > 0",
    "risk_flag_unknown_without_macro": "SELECT count(*) FROM v_signal WHERE NOT macro AND macro_risk IS NOT NULL HAVING count(*) > 0",
    "tier_unknown_without_opportunity": "SELECT count(*) FROM v_queue WHERE opportunity IS NULL AND tier <> 'Unknown' HAVING count(*) > 0",
    "safety_as_with_macro": f"SELECT 1 FROM v_pricing WHERE macro AND abs(safety - {_SAFETY}) > 0.02",
    "floor_below_ceiling": f"SELECT 1 FROM (SELECT 1) WHERE {T.pitch_floor} >= {T.expand_ready}",
    "index_months_enough": f"SELECT 1 FROM (SELECT count(*) AS n FROM v_index WHERE series_id = '{PRODUCER}') WHERE n < {T.least_index_months}",
    "index_resolves": f"SELECT 1 FROM (SELECT count(*) AS n FROM v_index WHERE series_id = '{PRODUCER}') WHERE n = 0",
    "signal_unique": "SELECT signal_id FROM v_signal GROUP BY signal_id HAVING count(*) > 1",
    "store_known": "SELECT 1 FROM v_signal WHERE store_id IS NULL",
    "no_cut_on_weak_benchmark": "SELECT 1 FROM v_pricing WHERE price_action = 'Review Price Reduction' AND reliability <> 'High'",
    "action_accepted": f"SELECT 1 FROM v_queue WHERE action NOT IN ({', '.join(map(repr, _ACTIONS))})",
} | {f"{k}_in_range": f"SELECT 1 FROM v_ready WHERE {k} NOT BETWEEN 0 AND 100" for k in _SCORES}


@query(" UNION ALL ".join(f"SELECT '{name}' AS expectation, count(*) AS violations FROM ({sql})" for name, sql in _CHECKS.items()))
def expectations(spark, sf):
    """Rows that break each expectation; all counts should be 0."""
    c = F.col
    x, scores, acts, intel, held = conformed(spark, sf), ready(spark, sf), queue(spark, sf), pricing(spark, sf), risk(spark, sf)
    index = producer_index(spark, sf)
    some = lambda df, p: df.where(p).agg(F.count("*").alias("n")).where(only_if(c("n")))
    months = index.where(c("series_id") == PRODUCER).agg(F.count("*").alias("n"))
    at = held.select("month", "store_id", "category", "margin", "promo_risk", "decay")
    found = {
        "category_product_floor": x.where("price is not null").groupBy("category").agg(F.count("*").alias("n")).where(c("n") < LEAST_PER_CATEGORY),
        "prior_coverage": intel.where("prior = 50").select("category").distinct(), "index_months_unique": unique(index, "series_id", "month"),
        "margin_unknown_without_index": some(held, c("ppi").isNull() & c("retail").isNotNull() & c("margin").isNotNull()), "shock_unknown_without_index": some(held, c("ppi").isNull() & c("cost_shock").isNotNull()),
        "position_unknown_without_index": some(held, c("cpi").isNull() & c("retail").isNotNull() & c("place").isNotNull()), "risk_flag_unknown_without_macro": some(signals(spark, sf), ~c("macro") & c("macro_risk").isNotNull()),
        "tier_unknown_without_opportunity": some(acts, c("opportunity").isNull() & (c("tier") != "Unknown")),
        "safety_as_with_macro": intel.where("macro").select("month", "store_id", "category", "safety").join(at, ["month", "store_id", "category"]).where(
            F.abs(c("safety") - markdown_safety(F.lit(True), c("margin"), c("promo_risk"), c("decay"))) > 0.02),
        "floor_below_ceiling": spark.range(1).where(F.lit(T.pitch_floor) >= F.lit(T.expand_ready)), "index_months_enough": months.where(c("n") < T.least_index_months), "index_resolves": months.where("n = 0"),
        "signal_unique": unique(signals(spark, sf), "signal_id"), "store_known": not_null(signals(spark, sf), "store_id"),
        "no_cut_on_weak_benchmark": intel.where((c("price_action") == "Review Price Reduction") & (c("reliability") != "High")), "action_accepted": accepted(acts, "action", _ACTIONS)}
    found |= {f"{k}_in_range": in_range(scores, k, 0, 100) for k in _SCORES}
    return reduce(DataFrame.unionByName, [violations(name, rows) for name, rows in found.items()])


# --- profiles -------------------------------------------------------------------------------------

_TABLES = {"lineitem": ("l_shipdate", "l_returnflag"), "orders": ("o_orderdate", "o_orderpriority"), "events": ("ts", "event_type"), "part": (None, "p_type")}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS total, {f'CAST(min({d}) AS DATE)' if d else 'NULL::DATE'} AS first_day, {f'CAST(max({d}) AS DATE)' if d else 'NULL::DATE'} AS last_day, count(DISTINCT {k}) AS kinds, {r(f'count_if({k} IS NULL) * 100.0::DOUBLE / count(*)')} AS null_pct FROM {t}" for t, (d, k) in _TABLES.items()))
def raw_profile(spark, sf):
    """Rows, span of dates, kinds and share of unknown kinds of each raw table."""
    def one(name: str, day: str | None, kind: str) -> DataFrame:
        at = F.to_date(day) if day else F.lit(None).cast("date")
        return table(spark, sf, name).agg(
            F.lit(name).alias("table_name"), F.count("*").alias("total"), F.min(at).alias("first_day"), F.max(at).alias("last_day"), F.count_distinct(kind).alias("kinds"),
            half_up(F.try_divide(F.count_if(F.col(kind).isNull()) * 100.0, F.count("*"))).alias("null_pct"))

    return reduce(DataFrame.unionByName, [one(t, d, k) for t, (d, k) in _TABLES.items()])


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, CASE WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'time' WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN column_type = 'DOUBLE' THEN 'number' ELSE 'text' END AS kind FROM (DESCRIBE {t})" for t in _TABLES))
def catalog_scan(spark, sf):
    """Columns and kinds of the raw tables, from their schemas: no rows are read."""
    kinds = {"bigint": "integer", "int": "integer", "double": "number", "string": "text", "date": "time", "timestamp": "time", "timestamp_ntz": "time"}
    return spark.createDataFrame([(t, c, kinds.get(k, "text")) for t in _TABLES for c, k in table(spark, sf, t).dtypes], "table_name string, column_name string, kind string")


_AUDITED = ["retail", "ppi", "cpi", "searched", "demand", "margin", "place", "ready", "rival_mean", "opportunity"]
_STATUS = "CASE WHEN nulls * 100.0 / total > 30 THEN 'critical' WHEN nulls * 100.0 / total > 10 THEN 'warning' ELSE 'ok' END"


@query(f"SELECT column_name, nulls, total, {r('nulls * 100.0::DOUBLE / total')} AS null_pct, {_STATUS} AS status FROM (SELECT c AS column_name, n AS nulls, total FROM (SELECT count(*) AS total, {', '.join(f'count_if({k} IS NULL) AS {k}' for k in _AUDITED)} FROM v_queue) UNPIVOT (n FOR c IN ({', '.join(_AUDITED)})))")
def null_audit(spark, sf):
    """Nulls of the scores and what they rest on: one pass for all columns."""
    return audited(queue(spark, sf), _AUDITED)


def audited(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(k).isNull()).alias(k) for k in columns]).unpivot("total", columns, "column_name", "nulls")
    pct = F.try_divide(F.col("nulls") * 100.0, F.col("total"))
    return counts.select("column_name", "nulls", "total", half_up(pct).alias("null_pct"), first_match([(pct > 30, "critical"), (pct > 10, "warning")], "ok").alias("status"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS score, {r(f'avg({k})')} AS mean, {r(f'stddev_samp({k})')} AS noise, min({k}) AS low, max({k}) AS high, stddev_samp({k}) < 5 AS suspicious FROM v_queue" for k in _SCORES))
def score_distributions(spark, sf):
    """Mean, deviation and range of each score; one that hardly varies is suspicious."""
    x = scored(spark, sf).select(*_SCORES).unpivot([], _SCORES, "score", "v")
    return x.groupBy("score").agg(half_up(F.avg("v")).alias("mean"), half_up(F.stddev_samp("v")).alias("noise"), F.min("v").alias("low"), F.max("v").alias("high"), (F.stddev_samp("v") < 5).alias("suspicious"))


@query("SELECT CAST(least(9, floor(demand / 10)) AS BIGINT) AS bin, count(*) AS n FROM v_queue WHERE demand IS NOT NULL GROUP BY ALL")
def score_histogram(spark, sf):
    """Ten equal bins; the upper end belongs to the last one."""
    bin_ = F.least(F.lit(9), F.width_bucket("demand", F.lit(0.0), F.lit(100.0), F.lit(10)) - 1)
    return scored(spark, sf).where("demand is not null").groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


_QUARTILES = ", ".join(r(f"quantile_cont(demand, {q})", 4) + f" AS q{int(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))


@query(f"SELECT category, {_QUARTILES} FROM v_queue GROUP BY category")
def score_boxes(spark, sf):
    """Percentiles with linear interpolation, by category."""
    q = F.percentile("demand", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    x = scored(spark, sf).groupBy("category").agg(q.alias("q"))
    return x.select("category", *[half_up(F.get("q", F.lit(k)), 4).alias(n) for k, n in enumerate(("q5", "q25", "q50", "q75", "q95"))])


_PAIRS = list(combinations(_SCORES, 2))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 6)} AS r, abs(corr({a}, {b})) > 0.85 AS high FROM v_queue" for a, b in _PAIRS))
def corr_matrix(spark, sf):
    """The correlation of each pair of scores, and whether it makes one of them redundant; one pass for all pairs."""
    one = scored(spark, sf).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in _PAIRS])
    x = one.unpivot([], [f"`{a}|{b}`" for a, b in _PAIRS], "pair", "r")
    name = F.split("pair", r"\|")
    return x.select(F.get(name, F.lit(0)).alias("a"), F.get(name, F.lit(1)).alias("b"), half_up(F.col("r"), 6).alias("r"), (F.abs("r") > 0.85).alias("high"))


view("v_ranks", "SELECT rank() OVER (ORDER BY demand DESC) + (count(*) OVER (PARTITION BY demand) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY shelf_risk DESC) + (count(*) OVER (PARTITION BY shelf_risk) - 1) / 2.0::DOUBLE AS b FROM v_queue WHERE demand IS NOT NULL AND shelf_risk IS NOT NULL")


@query(f"SELECT {r('corr(a, b)', 6)} AS spearman, count(*) AS n FROM v_ranks")
def spearman(spark, sf):
    """Rank correlation of demand and shelf risk, ties sharing their mean rank."""
    x = scored(spark, sf).where("demand is not null and shelf_risk is not null").select("demand", "shelf_risk")
    x = average_rank(average_rank(x, "demand", "a"), "shelf_risk", "b")
    return x.agg(half_up(F.corr("a", "b"), 6).alias("spearman"), F.count("*").alias("n"))


@query("SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, action) AS BIGINT) AS place FROM (SELECT category, action, count(*) AS n FROM v_queue GROUP BY ALL)")
def action_counts(spark, sf):
    """value_counts of actions by category, and the place of each."""
    x = queue(spark, sf).groupBy("category", "action").agg(F.count("*").alias("n"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "action")).cast("long"))


# --- freshness and the whole ----------------------------------------------------------------------

#: Days after which a source is stale.
MOST_DAYS = {"retail": 7, "terms": 14, "producer": 45, "consumer": 45, "rival": 14}


@query(" UNION ALL ".join(f"SELECT '{k}' AS source, CAST({k} AS DATE) AS last_day, date_diff('day', CAST({k} AS DATE), CAST(as_of AS DATE)) AS days, CASE WHEN {k} IS NULL THEN 'NO DATA' WHEN date_diff('day', CAST({k} AS DATE), CAST(as_of AS DATE)) > {d} THEN 'STALE' ELSE 'FRESH' END AS status FROM v_collected" for k, d in MOST_DAYS.items()))
def freshness_status(spark, sf):
    """The age of each source against its limit."""
    c, ages = F.col, ["retail", "producer", "consumer", "rival"]
    x = collected(spark, sf).withColumn("as_of", F.to_date(F.greatest(*ages) + F.expr("INTERVAL 1 DAY")))
    x = x.select("as_of", F.explode(F.array(*[F.struct(F.lit(k).alias("source"), F.to_date(k).alias("last_day"), F.lit(d).alias("most")) for k, d in MOST_DAYS.items()])).alias("s")).select("as_of", "s.*")
    days = F.date_diff("as_of", "last_day").cast("long")
    return x.select("source", "last_day", days.alias("days"), first_match([(c("last_day").isNull(), "NO DATA"), (days > c("most"), "STALE")], "FRESH").alias("status"))


@query(f"""SELECT critical::BIGINT AS critical, warnings::BIGINT AS warnings, suspicious::BIGINT AS suspicious, stale::BIGINT AS stale, redundant::BIGINT AS redundant, greatest(0, least(100, 100 - 10 * critical - 3 * warnings - 5 * suspicious - 8 * stale - 2 * redundant))::BIGINT AS quality FROM
  (SELECT count_if(status = 'critical') AS critical, count_if(status = 'warning') AS warnings FROM (SELECT {_STATUS} AS status FROM (SELECT n AS nulls, total FROM (SELECT count(*) AS total, {', '.join(f'count_if({k} IS NULL) AS {k}' for k in _AUDITED)} FROM v_queue) UNPIVOT (n FOR c IN ({', '.join(_AUDITED)}))))),
  (SELECT {' + '.join(f'CASE WHEN stddev_samp({k}) < 5 THEN 1 ELSE 0 END' for k in _SCORES)} AS suspicious, {' + '.join(f'CASE WHEN abs(corr({a}, {b})) > 0.85 THEN 1 ELSE 0 END' for a, b in _PAIRS)} AS redundant FROM v_queue),
  (SELECT {' + '.join(f"CASE WHEN {k} IS NULL OR date_diff('day', CAST({k} AS DATE), CAST(as_of AS DATE)) > {d} THEN 1 ELSE 0 END" for k, d in MOST_DAYS.items())} AS stale FROM v_collected)""")
def quality_score(spark, sf):
    """One number of 100: minus 10 a column of many nulls, 3 one of some, 5 a flat score, 8 a stale source, 2 a redundant pair."""
    nulls = null_audit(spark, sf).agg(F.count_if(F.col("status") == "critical").alias("critical"), F.count_if(F.col("status") == "warning").alias("warnings"))
    flat = score_distributions(spark, sf).agg(F.count_if("suspicious").alias("suspicious"))
    stale = freshness_status(spark, sf).agg(F.count_if(F.col("status") != "FRESH").alias("stale"))
    pairs = corr_matrix(spark, sf).agg(F.count_if("high").alias("redundant"))
    x = nulls.crossJoin(flat).crossJoin(stale).crossJoin(pairs)  # one row each
    score = 100 - 10 * F.col("critical") - 3 * F.col("warnings") - 5 * F.col("suspicious") - 8 * F.col("stale") - 2 * F.col("redundant")
    return x.withColumn("quality", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long"))


@query("SELECT store_id, category FROM v_retail WHERE flag = 'R' AND day >= (SELECT max(day) FROM v_retail WHERE flag = 'R') - INTERVAL 6 DAY GROUP BY ALL")
def recent_pairs(spark, sf):
    """Pairs that the competitor's feed brought in its last seven days: they need no other call."""
    x = conformed(spark, sf).where("flag = 'R'").select("store_id", "category", "day")
    last = F.broadcast(x.agg(F.max("day").alias("last")))  # one row
    return x.join(last).where(F.col("day") >= F.date_sub("last", 6)).select("store_id", "category").distinct()


_DUE = "date_diff('day', last, today)"


@query(f"""SELECT source, last, {_DUE}::BIGINT AS days, CASE WHEN last IS NULL OR {_DUE} > 16 THEN 'error' WHEN {_DUE} > 9 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT l_returnflag AS source, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY ALL), (SELECT CAST(max(o_orderdate) AS DATE) + 1 AS today FROM orders)""")
def source_due(spark, sf):
    """Warn or error by the age of each feed of prices (by return flag), at the day after the latest order: a clock that the feeds do not make."""
    today = F.broadcast(table(spark, sf, "orders").agg(F.date_add(F.to_date(F.max("o_orderdate")), 1).alias("today")))  # one row
    feeds = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("source")).agg(F.to_date(F.max("l_shipdate")).alias("last")).crossJoin(today)
    days = F.date_diff("today", "last")
    return feeds.select("source", "last", days.cast("long").alias("days"), due_status(days, 9, 16).alias("status"))
