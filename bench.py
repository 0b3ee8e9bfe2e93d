"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_RUNS (default 3)
set the data, the cores and the number of timed runs; the median run of each query counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tideloom.plans import QUERIES

HEADLINE = [
    "resample_sum",
    "dense_grid",
    "row_position",
    "iqr_filter",
    "scale_robust",
    "ffill",
    "rolling_std",
    "feature_matrix",
    "strided_panel_windows",
    "sliding_windows",
    "weighted_resample",
    "seasonal_decompose",
    "stationarity_test",
    "arima_fit",
    "sarimax_grid_fit",
    "window_linear_forecast",
    "mse_aligned",
    "metrics5",
]


def run_once(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tideloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        # A few megabytes per stage: sized by bytes, most stages would run on one core.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tideloom-bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    run_once(spark, "resample_sum", sf_dir)
    seconds = {
        name: round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3) for name in names
    }
    report = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
