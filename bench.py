"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from causeway.plans import catalog

HEADLINE = ["c12_profile", "c3_continuous_stats", "j1_ols", "j1_by_segment", "j5_dr_learner", "k1_weighting", "l1_group_time", "o11_refutations", "o12_spec_curve", "t1_uplift", "t3_deciles", "s1_always_valid"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    for name in HEADLINE[:2]:  # start the JVM's compilers
        queries[name](spark, sf_dir).collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            spark.catalog.clearCache()
        seconds[name] = round(statistics.median_low(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
