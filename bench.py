"""Benchmark: run the headline queries on $BENCH_SF_DIR and print one JSON line.

Each query is fully evaluated with the ``noop`` sink (no collect to the
driver).  One untimed warm-up query runs first (JVM start, JIT).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logweave.plans.catalog import QUERIES  # noqa: E402
from logweave.session import build_session  # noqa: E402

HEADLINE = [
    "parse_entries", "severity_distribution", "line_filter", "search_text", "entries_page",
    "services_by_freq", "session_liveness", "pattern_rollup", "top_patterns", "recurring_errors",
    "restart_loops", "error_rate", "incidents", "alerts", "simhash_codes", "near_dup_pairs",
    "leader_clusters", "incident_digest", "token_budget", "collapse_multiline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="logweave-bench", shuffle_partitions=max(8, cpus))
    QUERIES["severity_distribution"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as exc:  # keep measuring the others; report the failure
            errors[name] = type(exc).__name__
            continue
        times[name] = round(time.perf_counter() - t0, 3)
    n_lines = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus, "log_lines": n_lines,
        "parse_lines_per_sec": round(n_lines / times["parse_entries"], 1) if "parse_entries" in times else None,
        "slowest_query_sec": max(times.values()) if times else None,
        "errors": errors,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
