"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).  Each query runs once to warm up and once for
the clock; results go to the ``noop`` sink, which computes every row and keeps none.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quirework import catalog  # noqa: E402
from quirework.session import build_session  # noqa: E402

HEADLINE = [
    "search_flagship", "reading_order", "page_text", "document_text", "search_hits", "select_in_rect", "select_by_flow",
    "apply_redactions", "delete_pages", "reorder_pages", "nup_layout", "rotate_annotations", "visible_pages",
    "annotations_by_page", "apply_changes", "undo_redo", "recent_files_per_user", "html_to_text",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("quirework-bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, sum of second runs", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
