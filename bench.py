"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of cores. Each query runs
to its last row (`noop` sink). A small query warms the JVM up first; tables that
several queries share are written, and timed, as `store_*`.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stopwise.plans import catalog  # noqa: E402
from stopwise.session import local_session  # noqa: E402

HEADLINE = [
    "processed_dataset", "join_datasets", "aggregate_articles", "data_summary", "row_funnel",
    "stats_by_hour", "stats_by_floor", "describe_numeric", "correlation_matrix", "weight_class_stats", "eda_summary",
    "target_hist", "target_ecdf", "boxplot_target",
    "evaluate_by_split", "errors_by_range", "error_percentiles", "qq_line", "sample_5pct",
    "first_per_order", "feature_lookup", "score_batch_rule", "prediction_statistics", "feature_drift", "train_gbt",
]
SHARED = {
    "store_explored": catalog._explore,
    "store_processed": catalog._stored,
    "store_features": catalog._features,
    "store_predictions": catalog._errors,
    "store_logs": catalog.feature_log_rows,
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, partitions=int(cores))
    queries = catalog.all_queries() | {"errors_by_range": catalog.mae_by_range}
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    timings: dict[str, float] = {}

    def run(name: str, query) -> None:
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)

    run("processed_dataset_cold", queries["processed_dataset"])
    for name, query in SHARED.items():
        run(name, query)
    for name in HEADLINE:
        run(name, queries[name])
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(folder)}))


main()
