"""Time the headline queries: prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every query runs
whole, into a sink that discards rows, after one untimed query has warmed the JVM.
$BENCH_QUERIES picks other queries, $BENCH_RUNS takes the median of several runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftmark.session import local_session  # noqa: E402
from workload import registered  # noqa: E402

HEADLINE = [
    "ecosystem_metrics", "match_project_centric", "fn_taxonomy", "report_matrix", "mcnemar",
    "diff_summary", "content_hash", "canonicalize", "balance", "gt_statistics",
    "version_selection", "version_in_range_a", "scan_snyk", "scan_osv", "nvd_buckets",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus)
    queries = registered()
    warm = queries["gt_summary"][0](spark, sf_dir)
    warm.write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", "").split() or HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(sorted(taken)[len(taken) // 2], 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
