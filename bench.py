"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: input folder (default /root/testdata/sf0.1). BENCH_CPUS: cores (default 8).
BENCH_QUERIES: comma-separated names instead of the headline queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from datamill.queries import all_queries  # noqa: E402
from datamill.session import local_session  # noqa: E402

HEADLINE = [
    "dataset_stats", "label_deficit", "valid_examples", "dedup_exact", "trigram_stats", "fuzzy_pairs", "dedup_greedy",
    "cosine_pairs", "semantic_dedup", "split", "stratified_split", "kfold", "augment", "confusion", "class_report",
    "error_taxonomy", "calibration", "score_metrics", "ensemble_vote", "dropout_std", "entities", "entity_metrics",
    "token_features", "text_features", "similar_topk", "balanced_pick", "diverse_pick", "confidence_filter", "judge_scores",
    "zero_shot", "experiment_stats", "best_experiment", "cache_misses", "task_violations", "tfidf_top", "text_classifier",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", **{"spark.ui.showConsoleProgress": "false"})
    found = all_queries()
    # One run that loads classes and starts the Python workers; it is not timed.
    found["trigram_stats"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        found[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
