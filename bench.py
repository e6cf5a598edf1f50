"""Headline queries, timed: one JSON line on standard output.

Every query is run to the end (`noop` sink, all columns); the number is the median of the
repeats after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from rankflow import session
from rankflow.queries import all_queries

HEADLINE = [
    "numeric_profile", "winsor_scale", "treat_outliers", "forward_fill", "first_per_entity", "outer_merge",
    "fuzzy_edit_match", "rating_sums", "learned_weights", "content_top_n", "similarity_cosine", "hybrid_scores",
    "constraint_relaxation", "recommend",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    for name in names:
        if name not in queries:
            continue
        times = []
        for _ in range(repeats + 1):
            started = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
