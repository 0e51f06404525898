"""Headline queries on local Spark; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "participant_summary", "run_comparison", "model_comparison", "leaderboard", "cpl_distribution", "match_reports",
    "strict_prompts", "response_validation", "prediction_metrics", "loss_metrics", "reward_batches", "candidate_labels",
    "unique_candidate_specs", "candidate_rows", "signal_report", "choice_rows", "pair_rows", "comparison_rows",
    "choice_report", "vote_report", "veto_selection", "quality_funnel", "capped_samples", "relabel_distill",
    "relabel_stats", "error_stats", "tactical_gate", "position_page", "cache_stats", "one_run_summary", "model_label_lines",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    from plywise.plans import catalog
    from plywise.session import build_session

    spark = build_session("plywise-bench", f"local[{cpus}]", shuffle_partitions=int(cpus), driver_memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # small files over all threads
    queries = catalog.queries()
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in chosen:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
