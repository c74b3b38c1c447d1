"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from promptlake.catalog import all_queries  # noqa: E402
from promptlake.session import local_session  # noqa: E402

HEADLINE = [
    "l1_key", "normalize", "extract_keywords", "validate",
    "l1_attribute", "l1_attribute_split", "l1_lookup_asof", "quota_gate", "truncate_stream",
    "knn", "similar_pairs", "semantic_match", "semantic_absorb", "attribute_tiers", "cache_report",
    "latency_histogram", "latency_percentiles", "rate_5m", "cumulative_cost", "queue_depth", "moving_avg",
    "bench_stats", "threshold_sweep", "slo_check", "train_lang", "score_lang",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = all_queries()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
