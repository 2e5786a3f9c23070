"""Run the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line of seconds."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from oddsloom.plans import catalog

HEADLINE = ("cost_ladder", "cost_by_category", "walk_thin_books", "complete_sets", "complete_set_scan", "match_candidates", "ensemble", "strategy_summary", "strategy_slices", "price_as_of", "candidate_scores")


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    run = catalog.queries()
    # Start-up and compilation of the JVM are no part of a query's time.
    run[HEADLINE[0]](spark, os.environ.get("BENCH_WARM_DIR", sf_dir)).limit(1).collect()
    for name in HEADLINE:
        began = time.time()
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
