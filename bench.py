"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is built and run once on the smallest data, untimed, and then on the
bench data, timed from building the plan to the last row of every column.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from seqstates.catalog.queries import queries
from seqstates.sources.scratch import drop_materialized

HEADLINE = [
    "symbol_series",
    "bucketed_index",
    "range_index",
    "flip_then_subsample",
    "last_k",
    "gram_counts",
    "gram_counts_long",
    "context_states",
    "state_sequence",
    "transition_probs",
    "edge_labels",
    "sweep_runs",
    "sweep_runs_long",
    "sweep_runs_noisy",
    "sweep_runs_many",
    "summary_by_condition",
    "closure_report",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("seqstates-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = queries()
    seconds = {}
    for name in HEADLINE:
        if os.path.isdir(warm_dir):
            run(catalog[name](spark, warm_dir))
        start = time.perf_counter()
        run(catalog[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    drop_materialized(spark)
    spark.stop()
    result = {
        "metric": "seqstates_headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
