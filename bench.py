"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tidelane import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "grpo_advantage", "rloo_advantage", "reinforce_baseline_advantage", "grpo_passk_advantage", "discounted_returns", "gae_advantage", "task_pass_k", "macro_pass_k", "group_normalize", "majority_vote",
    "loss_aggregation", "dynamic_filter", "fixed_informative_prefix", "distribution", "hash_ranked_split", "latest_per_key", "balanced_partitions", "document_filter", "align_by_task", "exact_leakage",
    "as_of_forward", "interval_join", "call_receipt_pairs", "speech_segments", "running_known_flag", "bm25_top_k", "cosine_top_k",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            began = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
