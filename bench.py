"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8). Each query is
run once to warm up and then BENCH_RUNS times (default 3); the median counts. Rows are
produced in full and thrown away by the no-op sink.

The two tables that the queries read are single row groups of some MB, which only one task can read; tables of any size
that matters have thousands. So each is first written, untimed, as one file a core, with all its rows.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from fareloom.plans.queries import all_queries
from fareloom.session import local_session, scratch_path

HEADLINE = (
    "conform_batch",
    "unified_trips",
    "int_trips",
    "mart_daily",
    "mart_monthly",
    "daily_zone_summary",
    "check_required_nulls",
    "check_invalid_values",
    "check_duplicates",
    "test_unique",
    "stream_ingest",
    "incremental_daily",
    "gated_publish",
)


def timed(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def spread(spark, folder: str, cores: int) -> str:
    """A folder with the tables of the queries in as many files as there are cores."""
    target = scratch_path(spark, "bench")
    for table in ("lineitem", "events"):
        spark.read.parquet(f"{folder}/{table}.parquet").repartition(cores).write.parquet(f"{target}/{table}.parquet")
    return target


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, shuffle_partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds, tables = all_queries(), {}, spread(spark, folder, cores)
    for name in HEADLINE:
        timed(queries[name], spark, tables)
        seconds[name] = round(statistics.median(timed(queries[name], spark, tables) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
