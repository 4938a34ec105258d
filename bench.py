"""Time the headline queries: warm run, median of three, full result to the no-op sink.

A small table is one row group, which is one task. So the tables are first dealt to as many
files as a large table would have at least, outside the timing and outside the library.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from catalog.queries import QUERIES
from scriptloom.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "split_lines",
    "split_delimiter",
    "split_pattern",
    "rechunk_by_size",
    "batch_small_lines",
    "chunk_scripts",
    "chunk_pages",
    "chunk_documents",
    "structured_chunks",
    "line_depth",
    "with_progress",
    "lint_verdict",
    "lint_findings",
    "audit_summary",
    "dedup_chunks",
    "label_copies",
    "assemble",
    "only_new",
    "update_if",
    "lookup_many",
    "group_by",
]


TABLES = ["documents", "pages", "customer", "orders", "lineitem", "nation", "conversations"]


def dealt(spark, folder: str) -> str:
    """The tables in two files for each core."""
    for table in TABLES:
        rows = spark.read.parquet(f"{SF_DIR}/{table}.parquet")
        rows.repartition(2 * int(CPUS)).write.parquet(f"{folder}/{table}.parquet")
    return folder


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS)
    seconds = {}
    folder = tempfile.mkdtemp(prefix="bench-")
    sf_dir = dealt(spark, folder)
    for name in sys.argv[1:] or HEADLINE:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(RUNS)), 3)
    shutil.rmtree(folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, median warm seconds, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cores": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
