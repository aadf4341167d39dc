"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from catalume.plans.queries import QUERIES

HEADLINE = ["a1_recipe_abv", "h1_lineage", "h8_cost_guess", "j3_best_match", "j6_find_similar", "j8_strong_edges", "g3_union_graph", "p13_recipe_card", "g9_overlap_graph"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["s1_nodes"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the engine
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
