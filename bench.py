"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from basaltine import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Shapes of push-down benchmarks: scans, filters of several selectivities, counts, groups, orders.
HEADLINE = [
    "table_scan_ranges", "index_lookup", "selection", "filtered_count", "simple_aggregation", "group_by_few", "group_by_many", "group_by_expression", "group_by_two_columns",
    "stream_aggregation", "top_n", "top_n_three_columns", "partition_top_n", "merged_avg_and_variance", "request_pipeline", "read_as_of", "replica_table", "equi_depth_histogram",
    "functions_math", "functions_strings", "functions_dates", "functions_vector", "functions_json", "frequency_sketch", "distinct_sketch", "join_star", "join_range", "join_as_of", "streamed_replica",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles
            began = time.time()
            catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
