"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. A query is
run once to warm up and then ``BENCH_REPEATS`` times; its median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import QUERIES  # noqa: E402
from driftwalk.session import local_session  # noqa: E402

HEADLINES = [
    "row_index_long",
    "high_pass_filter",
    "high_pass_filter_long",
    "trend_labels",
    "prepare_features_and_labels",
    "robust_fit",
    "robust_transform",
    "write_chunks",
    "split_rows",
    "sliding_windows",
    "task_windows",
    "task_moments",
    "correlation_loss",
    "metric_spearman",
    "metric_spearman_large_groups",
    "metric_auroc",
    "adapt_features",
    "window_gate",
    "fit_tasks",
    "online_pass",
    "stream_labels",
]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    repeats = int(os.environ.get("BENCH_REPEATS", 1))
    spark = local_session(cores, "bench")
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        timed(spark, name, folder)
        seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
