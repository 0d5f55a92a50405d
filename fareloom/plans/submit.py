"""Run the warehouse from the command line, for use with spark-submit.

    spark-submit fareloom/plans/submit.py --database taxi \\
        --batch-file s3a://raw/april.parquet --batch-file s3a://raw/may.parquet \\
        --events s3a://raw/events --stream s3a://warehouse/stream --progress s3a://warehouse/progress
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession

from fareloom.config import DateWindow, WarehouseConfig
from fareloom.contracts import STREAM_SCHEMA
from fareloom.operators.tables import create_database
from fareloom.plans.taxi_warehouse import run
from fareloom.session import SETTINGS, cluster_settings
from fareloom.streaming.ingest import ingest_events, register_staged


def window(text: str) -> DateWindow:
    """`2025-04-01:2025-05-31`, both days included."""
    first, last = text.split(":")
    return DateWindow(date.fromisoformat(first), date.fromisoformat(last))


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    default = WarehouseConfig(database="")
    parser = argparse.ArgumentParser(description="Build the trip warehouse.")
    parser.add_argument("--database", required=True)
    parser.add_argument("--location", help="folder of the database, if not the catalog's default")
    parser.add_argument("--batch-file", action="append", required=True, help="a monthly file; may be repeated")
    parser.add_argument("--events", help="folder of new event files; leave out to use the stream table as it is")
    parser.add_argument("--stream", help="folder of the stream staging table")
    parser.add_argument("--progress", help="checkpoint folder of the ingestion")
    parser.add_argument("--batch-window", type=window, default=default.batch_window)
    parser.add_argument("--stream-window", type=window, default=default.stream_window)
    parser.add_argument("--shuffle-partitions", type=int, help="partitions that every shuffle starts with; outranks --conf")
    args = parser.parse_args(argv)
    if args.events and not (args.stream and args.progress):
        parser.error("--events needs --stream and --progress")
    return args


def session(shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the library's settings, where spark-submit was not given others."""
    spark = SparkSession.builder.appName("fareloom").getOrCreate()
    given = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in SETTINGS.items():
        if key not in given:
            spark.conf.set(key, value)
    if shuffle_partitions:
        for key, value in cluster_settings(shuffle_partitions).items():
            if value != SETTINGS[key]:
                spark.conf.set(key, value)
    return spark


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = session(args.shuffle_partitions)
    config = WarehouseConfig(
        database=args.database,
        location=args.location,
        batch_window=args.batch_window,
        stream_window=args.stream_window,
    )
    create_database(spark, config.database, config.location)
    if args.events:
        ingest_events(spark, args.events, STREAM_SCHEMA, args.stream, args.progress, rules=config.rules)
    if args.stream:
        register_staged(spark, config.database, config.tables.stream_staging, args.stream)
    for result in run(spark, config, args.batch_file):
        print(f"{result.table}  {result.gate}  {result.observed}  {'passed' if result.passed else 'failed'}")


if __name__ == "__main__":
    main()
