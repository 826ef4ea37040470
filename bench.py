"""Seconds of the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quartzfolio import catalog
from quartzfolio.session import DEFAULTS

HEADLINES = (
    "prioritize_parts", "decision_matrix", "budget_waterfall", "greedy_selection", "knapsack_selection", "daily_accuracy", "anomaly_detect",
    "session_activity", "stratified_sample", "budget_rollup", "item_similarity_join", "jaccard_pairs", "minhash_lsh_pairs", "cosine_topk", "bm25_topk", "keywords", "csv_scan", "portfolio_health", "risk_overall",
)

#: Seconds of a first run below which a query is timed three times.
SHORT = 30.0


def seconds(query, spark: SparkSession, sf_dir: str) -> float:
    began = time.time()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(cpus))
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    of = catalog.queries()
    took = {}
    for name in HEADLINES:
        first = seconds(of[name], spark, sf_dir)  # warms up
        took[name] = round(statistics.median(seconds(of[name], spark, sf_dir) for _ in range(3 if first < SHORT else 1)), 3)
    print(json.dumps({"metric": "headline queries, warm (median of 3), summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
