"""Times the engine's headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores.  Every query runs once
untimed, for compiled code, and then counts as the best of three runs that
read, compute and drop all rows.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ["to_intervals_lag", "select_add", "where_filter", "join_inner", "join_outer", "join_three_way", "asof_lookup", "tumbling_avg", "hopping_avg", "time_weighted_avg", "sliding_sum", "moving_sum_10", "normalize_window", "orders_norm", "resample_5_4", "interpolate_events", "running_totals", "recurrence_ema", "nested_top_events"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.catalog import QUERIES

    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times[1:]), 3)
    print(json.dumps({"metric": "headline queries, seconds in total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
