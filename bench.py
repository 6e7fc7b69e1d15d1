"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default: scale 0.1), ``BENCH_CPUS`` the cores. Every query runs to a
``noop`` sink, so all of its rows and columns are computed; the first run in the session warms up.
"""

from __future__ import annotations

import json
import os
import time

from foliant.plans.catalog import QUERIES
from foliant.session import local_session

HEADLINES = [
    "source_census", "node_counts", "toc_entries", "page_markdown", "paragraphs", "table_gfm", "timeline_blocks", "report_markdown",
    "page_stats", "capture_candidates", "missing_images",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)))

    def seconds(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    seconds("page_markdown")
    times = {name: seconds(name) for name in HEADLINES}
    total = round(sum(times.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": float(scale)}))


if __name__ == "__main__":
    main()
