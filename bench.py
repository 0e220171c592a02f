"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the number of cores.
Every query runs over whole tables and all of its rows are produced (``noop``
sink); the best of ``BENCH_RUNS`` runs counts. Tables of pages and documents
come as one file with one row group, which only one task can read; as on a
cluster they are first laid out in one file per core, and the search store is
written. Both are timed apart, as ``layout``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pageloom.plans import QUERIES  # noqa: E402
from pageloom.plans.search_queries import document_store  # noqa: E402
from pageloom.session import build_session  # noqa: E402

HEADLINE = (
    "link_table",
    "link_list",
    "url_resolution",
    "page_index_table",
    "image_list",
    "image_blobs",
    "page_markdown",
    "page_text",
    "page_head",
    "page_scores",
    "host_profiles",
    "scrape_decisions",
    "scrape_results",
    "cache_lookup",
    "cache_hits",
    "search_results",
    "search_response",
    "request_decode",
    "request_log_metrics",
    "crawl_pages",
    "streamed_scrape",
)


def laid_out(spark, folder: str, files: int) -> str:
    """The tables under a new folder: large texts in ``files`` files, all others as links."""
    target = os.path.join(tempfile.mkdtemp(prefix="bench-"), os.path.basename(folder))
    os.makedirs(target)
    for name in sorted(os.listdir(folder)):
        if name in ("pages.parquet", "documents.parquet"):
            spark.read.parquet(f"{folder}/{name}").repartition(files).write.parquet(f"{target}/{name}")
        else:
            os.symlink(f"{folder}/{name}", f"{target}/{name}")
    return target


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    folder = laid_out(spark, folder, int(cpus))
    layout = {"tables": round(time.perf_counter() - start, 3)}
    if any(name.startswith("search_re") for name in names):
        start = time.perf_counter()
        document_store(spark, folder)
        layout["search_store"] = round(time.perf_counter() - start, 3)
    pages = spark.read.parquet(f"{folder}/pages.parquet").count()
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            seen = Observation()
            result = QUERIES[name](spark, folder).observe(seen, F.count(F.lit(1)).alias("n"))
            result.write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
        rows[name] = seen.get["n"]
        print(f"{name} {best:.2f}s", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
                "layout": layout,
                "pages": pages,
                "rows": rows,
                "rows_per_sec": {n: round(rows[n] / times[n], 1) for n in times},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
