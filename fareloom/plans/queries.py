"""The operators as named queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.config import FEWER_ZONES, DateWindow, TripRules, WarehouseConfig
from fareloom.contracts import RAW_NAME, STREAM_SCHEMA, TRIP_CLUSTER, TRIP_SCHEMA
from fareloom.functions.rounding import exact_totals, rounded_mean, rounded_sum
from fareloom.functions.scalars import in_window
from fareloom.operators import column_tests, gates
from fareloom.operators.conform import (
    batch_trip_id,
    conform_batch,
    conform_stream,
    unified_trips,
    valid_batch,
    window_batch,
    window_stream,
)
from fareloom.operators.dedup import keep_latest
from fareloom.operators.marts import daily_mart, daily_totals, monthly_mart, zone_summary
from fareloom.operators.tables import (
    create_database,
    new_run_id,
    publish,
    qualified,
    replace_table,
    write_version,
)
from fareloom.plans import taxi_warehouse
from fareloom.plans.zone_summary import run_direct, run_models
from fareloom.session import scratch_path
from fareloom.sources.derived import EVENT_COLUMNS, event_day, raw_batch, raw_stream, stream_events, zone_trips
from fareloom.sources.files import read_files, stage_batch
from fareloom.streaming.ingest import ingest_events, read_rejected, read_staged, register_staged

Query = Callable[[SparkSession, str], DataFrame]

# The one ingestion time of all batch rows; fixed, so that results can be compared.
RUN_STAMP = datetime(2025, 8, 1)
CONFIG = WarehouseConfig(database="fareloom")

# Where the first monthly file ends and the second begins.
SECOND_FILE = date(2025, 5, 1)
# Trips of these days reach the incremental query only in its second load.
LATE = DateWindow(date(2025, 5, 16), date(2025, 5, 31))
# Events of these days come after the first run of the query that rebuilds trips.
LATE_STREAM = DateWindow(date(2025, 7, 20), date(2025, 7, 31))


def _fresh_config(spark: SparkSession) -> WarehouseConfig:
    """A database of its own below the shared scratch folder."""
    name = f"fareloom_{uuid4().hex}"
    location = scratch_path(spark, "database")
    create_database(spark, name, location)
    return WarehouseConfig(database=name, location=location)


def _conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources under the contract, before any rule is applied."""
    batch = conform_batch(raw_batch(spark, sf_dir), CONFIG, RUN_STAMP)
    return batch.unionByName(conform_stream(raw_stream(spark, sf_dir)))


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified_trips(raw_batch(spark, sf_dir), raw_stream(spark, sf_dir), CONFIG, RUN_STAMP)


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxi_warehouse.trips(raw_batch(spark, sf_dir), raw_stream(spark, sf_dir), CONFIG, RUN_STAMP)


def _zone_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_trips(raw_batch(spark, sf_dir), batch_trip_id())


def _before_and_after(spark: SparkSession, sf_dir: str, gate: Callable[[], gates.Gate]) -> DataFrame:
    """A gate on the rows as they arrive, where it fails, and on the finished trips, where it passes."""
    inputs = {"arrived": _conformed(spark, sf_dir), "finished": _trips(spark, sf_dir)}
    reports = [gates.evaluate(df, gate()).withColumn("checked", F.lit(name)) for name, df in inputs.items()]
    return reduce(DataFrame.unionByName, reports)


def _monthly_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The raw batch written as two monthly files."""
    raw = raw_batch(spark, sf_dir)
    folder = scratch_path(spark, "monthly")
    first = F.col(RAW_NAME["pickup_datetime"]).cast("date") < F.lit(SECOND_FILE)
    paths = [f"{folder}/first.parquet", f"{folder}/second.parquet"]
    for path, rows in zip(paths, (raw.where(first), raw.where(~F.coalesce(first, F.lit(False))))):
        rows.write.parquet(path)
    return paths


def _event_source(sf_dir: str) -> str:
    # The pattern finds the table whether it is one file or a folder of files.
    return f"{sf_dir}/events.parquet*"


def _ingested(spark: SparkSession, sf_dir: str, rules: TripRules | None = None) -> str:
    target = scratch_path(spark, "stream")
    checkpoint = scratch_path(spark, "stream-progress")
    # The second call finds nothing new and must not add a row.
    for _ in range(2):
        ingest_events(spark, _event_source(sf_dir), EVENT_COLUMNS, target, checkpoint, stream_events, rules=rules)
    return target


def _run_warehouse(spark: SparkSession, sf_dir: str) -> tuple[WarehouseConfig, list]:
    config = _fresh_config(spark)
    stream = _ingested(spark, sf_dir, CONFIG.rules)
    register_staged(spark, config.database, config.tables.stream_staging, stream)
    return config, taxi_warehouse.run(spark, config, _monthly_files(spark, sf_dir), RUN_STAMP)


def load_batch_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _fresh_config(spark)
    raw, run_id = read_files(spark, _monthly_files(spark, sf_dir)), new_run_id()
    stage_batch(raw, config.database, config.tables.batch_staging, run_id)
    return spark.table(publish(spark, config.database, config.tables.batch_staging, run_id))


def replace_table_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _fresh_config(spark)
    rows = window_stream(raw_stream(spark, sf_dir), config)
    for _ in range(2):
        name = replace_table(rows, config.database, config.tables.stream_staging, "pickup_date", TRIP_CLUSTER)
    return spark.table(name)


def layout_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _fresh_config(spark)
    name = write_version(
        _unified(spark, sf_dir), config.database, config.tables.trips, new_run_id(), "pickup_date", TRIP_CLUSTER
    )
    return spark.table(name)


def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create a table from a query, count its rows, drop it."""
    config = _fresh_config(spark)
    name = qualified(config.database, "smoke")
    raw_stream(spark, sf_dir).withColumn("created_at", F.current_timestamp()).write.saveAsTable(name)
    counted = spark.table(name).count()
    spark.sql(f"DROP TABLE {name}")
    gone = not spark.catalog.tableExists(name)
    return spark.range(1).select(F.lit(counted).cast("bigint").alias("row_count"), F.lit(gone).alias("dropped"))


def fingerprint_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_batch(spark, sf_dir)
    return raw.select(batch_trip_id().alias("trip_id"), RAW_NAME["pickup_datetime"], "total_amount")


def mart_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_mart(daily_totals(_trips(spark, sf_dir)))


def mart_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_mart(daily_totals(_trips(spark, sf_dir)))


def check_required_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the finished trips and on the stream staging table, which has no trip_id."""
    config = _fresh_config(spark)
    tables = {
        "arrived": write_version(raw_stream(spark, sf_dir), config.database, "stream", new_run_id()),
        "finished": write_version(_trips(spark, sf_dir), config.database, "trips", new_run_id()),
    }
    reports = [
        gates.evaluate_columns(spark, "check_required_schema", table).withColumn("checked", F.lit(name))
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, reports)


def check_mart_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.evaluate(mart_daily(spark, sf_dir), gates.has_rows("check_mart_row_count"))


def assert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.check_assertions(daily_zone_summary(spark, sf_dir), gates.summary_assertions())


def daily_zone_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_summary(_zone_trips(spark, sf_dir))


def zone_summary_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of valid trips as a published table."""
    config = _fresh_config(spark)
    source = zone_trips(valid_batch(raw_batch(spark, sf_dir), config), batch_trip_id())
    return run_direct(source, config.database, config.location)


def zone_models_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary as two tested models over the finished trips."""
    config = _fresh_config(spark)
    source = _trips(spark, sf_dir).select(
        "trip_id",
        F.col("pickup_date").alias("trip_date"),
        F.col("pickup_location_id").alias("pickup_zone_id"),
        "total_amount",
    )
    return run_models(source, config.database, config.location)


def test_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["lpep_pickup_datetime", "PULocationID", "passenger_count", "total_amount"]
    tests = [column_tests.ColumnTests(name, not_null=True) for name in columns]
    return column_tests.run_column_tests(raw_batch(spark, sf_dir), tests)


def test_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key test on the rows as they arrive and on the finished trips."""
    key = [column_tests.ColumnTests("trip_id", unique=True)]
    inputs = {"arrived": _unified(spark, sf_dir), "finished": _trips(spark, sf_dir)}
    reports = [column_tests.run_column_tests(df, key).withColumn("checked", F.lit(n)) for n, df in inputs.items()]
    return reduce(DataFrame.unionByName, reports)


def test_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tests declared for the two summary models."""
    staged = _zone_trips(spark, sf_dir)
    models = {
        "stg_trips": (staged, column_tests.STAGED_TRIP_TESTS),
        "daily_trip_summary": (zone_summary(staged), column_tests.DAILY_SUMMARY_TESTS),
    }
    reports = [
        column_tests.run_column_tests(df, tests).withColumn("model", F.lit(n)) for n, (df, tests) in models.items()
    ]
    return reduce(DataFrame.unionByName, reports)


def test_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pickup zones of the monthly rows that no stream trip has as pickup zone."""
    return column_tests.relationship_failures(
        raw_batch(spark, sf_dir), RAW_NAME["pickup_location_id"], raw_stream(spark, sf_dir), "pickup_location_id"
    )


def _rebuilt(spark: SparkSession, sf_dir: str) -> WarehouseConfig:
    """Marts built before the late days arrived, brought up to date by rebuilding only these days."""
    config = _fresh_config(spark)
    database, names = config.database, config.tables
    full = spark.table(replace_table(_trips(spark, sf_dir), database, names.trips, "pickup_date", TRIP_CLUSTER))
    early = daily_totals(full.where(~in_window(F.col("pickup_date"), LATE)))
    taxi_warehouse.publish_marts(spark, config, early, new_run_id(), lambda _, *reports: gates.require(*reports))
    taxi_warehouse.rebuild_days(spark, config, LATE)
    return config


def _late_events(spark: SparkSession, sf_dir: str) -> WarehouseConfig:
    """A run without the events of the late days, then a rebuild of these days once their events have come.

    Many of them are newer copies of trips that are published on another day.
    """
    config = _fresh_config(spark)
    folder, target, progress = (scratch_path(spark, n) for n in ("events", "stream", "stream-progress"))
    events = spark.read.schema(EVENT_COLUMNS).parquet(_event_source(sf_dir))
    late = in_window(event_day(), LATE_STREAM)
    for number, arrived in enumerate((~late, late)):
        events.where(arrived).write.parquet(f"{folder}/{number}.parquet")
        ingest_events(spark, f"{folder}/*.parquet", EVENT_COLUMNS, target, progress, stream_events, rules=config.rules)
        register_staged(spark, config.database, config.tables.stream_staging, target)
        if number == 0:
            taxi_warehouse.run(spark, config, _monthly_files(spark, sf_dir), RUN_STAMP)
    taxi_warehouse.rebuild_trips(spark, config, LATE_STREAM, RUN_STAMP)
    return config


def incremental_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _late_events(spark, sf_dir)
    return spark.table(qualified(config.database, config.tables.trips)).select(*TRIP_SCHEMA.names)


def incremental_trip_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _late_events(spark, sf_dir)
    return spark.table(qualified(config.database, config.tables.daily_mart))


def incremental_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _rebuilt(spark, sf_dir)
    return spark.table(qualified(config.database, config.tables.daily_mart))


def incremental_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _rebuilt(spark, sf_dir)
    return spark.table(qualified(config.database, config.tables.monthly_mart))


def fractional_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and means of amounts whose digits go on for ever."""
    raw = raw_batch(spark, sf_dir)
    sevenths = exact_totals("share", F.col("total_amount") / 7)
    grouped = raw.groupBy("PULocationID").agg(*sevenths)
    return grouped.select("PULocationID", rounded_sum("share").alias("total_share"), rounded_mean("share").alias("average_share"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_staged(spark, _ingested(spark, sf_dir)).select(*STREAM_SCHEMA.names)


def stream_ingest_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_staged(spark, _ingested(spark, sf_dir, CONFIG.rules)).select(*STREAM_SCHEMA.names)


def stream_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that were set aside, and the rule that each of them breaks."""
    return read_rejected(spark, _ingested(spark, sf_dir, FEWER_ZONES)).select(*STREAM_SCHEMA.names, "broken_rule")


def gated_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, results = _run_warehouse(spark, sf_dir)
    rows = [(r.table, r.gate, r.observed, r.passed) for r in results]
    return spark.createDataFrame(rows, "table_name string, gate string, observed bigint, passed boolean")


def published_daily_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, _ = _run_warehouse(spark, sf_dir)
    return spark.table(qualified(config.database, config.tables.daily_mart))


def published_monthly_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, _ = _run_warehouse(spark, sf_dir)
    return spark.table(qualified(config.database, config.tables.monthly_mart))


def all_queries() -> dict[str, Query]:
    return {
        "load_batch_staging": load_batch_staging,
        "replace_table_rerun": replace_table_rerun,
        "layout_roundtrip": layout_roundtrip,
        "table_roundtrip": table_roundtrip,
        "conform_batch": lambda s, d: conform_batch(raw_batch(s, d), CONFIG, RUN_STAMP),
        "conform_stream": lambda s, d: conform_stream(raw_stream(s, d)),
        "fingerprint_trips": fingerprint_trips,
        "window_batch": lambda s, d: window_batch(raw_batch(s, d), CONFIG),
        "window_stream": lambda s, d: window_stream(raw_stream(s, d), CONFIG),
        "valid_batch": lambda s, d: valid_batch(raw_batch(s, d), CONFIG),
        "unified_trips": _unified,
        "dedup_latest": lambda s, d: keep_latest(_conformed(s, d)),
        "int_trips": _trips,
        "mart_daily": mart_daily,
        "mart_monthly": mart_monthly,
        "daily_zone_summary": daily_zone_summary,
        "zone_summary_run": zone_summary_run,
        "zone_models_run": zone_models_run,
        "check_batch_row_count": lambda s, d: gates.evaluate(
            raw_batch(s, d), gates.has_rows("check_batch_row_count")
        ),
        "check_required_nulls": lambda s, d: gates.evaluate(
            raw_batch(s, d), gates.has_values("check_batch_required_nulls")
        ),
        "check_required_schema": check_required_schema,
        "check_invalid_values": lambda s, d: _before_and_after(
            s, d, lambda: gates.has_valid_values("check_invalid_values", CONFIG.rules)
        ),
        "check_duplicates": lambda s, d: _before_and_after(s, d, lambda: gates.has_unique_key("check_duplicates")),
        "check_stream_exists": lambda s, d: gates.evaluate(
            gates.stream_rows(raw_stream(s, d), CONFIG.stream_window), gates.has_rows("check_stream_data_exists")
        ),
        "check_mart_row_count": check_mart_row_count,
        "assert_summary": assert_summary,
        "test_not_null": test_not_null,
        "test_unique": test_unique,
        "test_declared": test_declared,
        "test_relationships": test_relationships,
        "incremental_trips": incremental_trips,
        "incremental_trip_marts": incremental_trip_marts,
        "incremental_daily": incremental_daily,
        "incremental_monthly": incremental_monthly,
        "fractional_amounts": fractional_amounts,
        "stream_ingest": stream_ingest,
        "stream_ingest_validated": stream_ingest_validated,
        "stream_rejected": stream_rejected,
        "gated_publish": gated_publish,
        "published_daily_mart": published_daily_mart,
        "published_monthly_mart": published_monthly_mart,
    }
