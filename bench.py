"""Times the marts and the headline queries at $BENCH_SF_DIR; prints one JSON line.

Each run drops the stored marts, so that `build_*` are what it takes to make and
store a mart (from stored ones below it) and the others what it takes to answer from them, or from the raw
tables.  After a warm-up run the medians of three runs count.
"""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from gondola.plans import facts, marts, pricing, scores, serving
from gondola.sources import tables, workspace

BUILDS = {"conformed": tables.conformed, "shelves": facts.shelves, "signals": facts.signals, "own_prices": facts.own_prices, "rival_prices": facts.rival_prices, "prices": facts.prices, "demand": scores.demand, "risk": scores.risk, "ready": scores.ready, "pricing": pricing.pricing, "actions": serving.actions, "queue": serving.queue}
HEADLINE = ["weekly_price_fact", "gaps_islands", "weekly_events", "market_signals", "demand_gap", "price_margin", "pricing_intelligence", "action_queue", "topk_actions", "store_list", "macro_features", "demand_features",
            "asof_carry_forward", "category_cv", "two_level_count", "transition_persistence", "store_health", "cosine_topk", "unit_size_parse", "expectations"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, list[float]] = {}

    def timed(name, work) -> None:
        start = time.time()
        work()
        times.setdefault(name, []).append(time.time() - start)

    for _ in range(4):
        workspace.forget(spark, sf)
        for name, build in BUILDS.items():
            timed(f"build_{name}", lambda build=build: build(spark, sf))
        for name in HEADLINE:
            timed(name, lambda name=name: marts.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    took = {name: round(median(t[1:]), 3) for name, t in times.items()}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
