"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the median seconds of three warm runs."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "flagship", "blocks_explode", "running_heads", "token_counts", "stylometry", "pii_spans", "rule_findings", "injection_score", "lookup_match_status", "asof_version",
    "interval_lookup", "timeline_inversions", "cross_doc_contradictions", "duplicate_groups", "benchmark_contained", "risk_index", "release_gate", "citation_groups", "majority_vote",
    "monthly_usage", "sum_check", "percent_check", "interest_schedule", "numbering_gaps", "bm25_topk", "query_profile", "coverage_gate", "prf_by_error", "resource_percentiles",
    "hash_chain_verify", "ledger_balance", "lease_sessions", "table_totals",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from attestor.plans.catalogue import QUERIES, flagship

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        f = flagship if name == "flagship" else QUERIES[name]
        took = []
        for k in range(RUNS + 1):
            began = time.perf_counter()
            f(spark, SF).write.format("noop").mode("overwrite").save()
            if k or RUNS == 0:
                took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF, "cpus": CPUS}))


if __name__ == "__main__":
    main()
