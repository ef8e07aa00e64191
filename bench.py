"""Benchmark: headline jobs over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each job runs once to warm up and once for the clock, its result fully
materialised into the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registered  # noqa: E402
from postmill.session import local_session  # noqa: E402

HEADLINE = (
    "register_build", "register_merge", "company_match_all", "sector_refresh", "postings_normalise",
    "posting_lifecycle", "search_facets_filters", "search_page_filters", "org_search_facets", "match_all",
    "digest_content", "watch_list_changes", "coverage", "page_evidence", "source_greenhouse",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "12g"), partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    seconds = {}
    for name in only:
        best = None
        # The lifecycle replays seven scans; its own first scans warm it up.
        for _ in range(1 if name == "posting_lifecycle" else 2):
            t0 = time.perf_counter()
            registered.QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - t0)
        seconds[name] = round(best, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_jobs_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
