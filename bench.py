"""Headline queries, timed; prints one JSON line.

Each query runs once to warm up the JVM (its time is not counted) and then ``BENCH_RUNS`` times; the best run counts.
A run includes building the plan, since some operators write intermediate tables while building.
"""

from __future__ import annotations

import json
import os
import sys
import time

from foliospark.catalog import QUERIES
from foliospark.plans.session import local_session

HEADLINE = ["book_text", "detect_toc_pages", "parse_toc", "nms_lines", "auto_levels", "greedy_decode"]
INPUTS = {
    "book_text": "documents",
    "detect_toc_pages": "part",
    "parse_toc": "part",
    "nms_lines": "lineitem",
    "auto_levels": "lineitem",
    "greedy_decode": "embeddings",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores))
    seconds: dict[str, float] = {}
    rows_per_second: dict[str, int] = {}
    for name in names:
        best = float("inf")
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
        if name in INPUTS:
            n = spark.read.parquet(f"{sf_dir}/{INPUTS[name]}.parquet").count()
            rows_per_second[name] = int(n / best)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "input_rows_per_sec": rows_per_second,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cores),
            }
        )
    )


if __name__ == "__main__":
    main()
