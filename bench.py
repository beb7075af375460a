"""Time the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from shrinkwise.plans.queries import QUERIES
from shrinkwise.session import local_session

HEADLINES = [
    "savings_by_ext",
    "size_summary",
    "route_actions",
    "output_plan",
    "archive_first_violation",
    "repack_candidates",
    "image_decisions",
    "image_counters",
    "first_use_top50",
    "mask_join",
    "label_lookup",
    "cleanup_empty_dirs",
    "tree_diff",
    "progress_rank",
    "event_dispatch",
    "job_state",
    "payload_recompress",
    "archive_roundtrip",
    "stream_job_state",
]


def run(name: str, spark, sf_dir: str) -> float:
    """Build the query and compute every row and column of its result."""
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cores, app="bench")
    run("savings_by_ext", spark, sf_dir)  # JVM and code generation warm up
    seconds = {name: round(run(name, spark, sf_dir), 3) for name in HEADLINES}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
