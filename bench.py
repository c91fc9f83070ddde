"""Benchmark: headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line. Each query runs once after a warm-up of the session on a small table,
and its whole result is written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.plans.queries import QUERIES  # noqa: E402
from riskloom.session import local_session  # noqa: E402

HEADLINE = [
    "explode_lines", "scan_all", "scan_documents", "scan_pages", "match_lines", "rules_sec", "missing_in_window",
    "extract_block_items", "denylist_match", "denylist_join", "redact_pii", "score", "rule_rollup", "top_rules",
    "rules_fired", "consecutive_diff", "score_trend", "suppressed_status", "apply_profile", "gate_new_only",
    "report_json", "report_sarif", "leak_audit", "evaluate", "stream_scan", "stream_severity_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in ("scan_all", "scan_documents"):
        QUERIES[name](spark, warm if os.path.isdir(warm) else sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
