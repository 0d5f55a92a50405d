"""The small daily zone summary: staged model, summary model, column tests, assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fareloom.operators.column_tests import DAILY_SUMMARY_TESTS, STAGED_TRIP_TESTS, ColumnTests, run_column_tests
from fareloom.operators.gates import QualityGateError, assert_all, summary_assertions
from fareloom.operators.marts import zone_summary
from fareloom.operators.tables import (
    create_database,
    drop_old_versions,
    drop_unpublished,
    new_run_id,
    publish,
    qualified,
    write_version,
)

STAGED = "stg_trips"
SUMMARY = "daily_trip_summary"


def _require(df: DataFrame, table: str, tests: tuple[ColumnTests, ...]) -> None:
    failed = run_column_tests(df, tests).where("not passed").collect()
    if failed:
        raise QualityGateError("; ".join(f"{r['test']} {table}.{r['column']}: {r['failures']}" for r in failed))


def _published(spark: SparkSession, database: str, run_id: str, *tables: str) -> DataFrame:
    """Publish the tables of a run, keep two versions of each, and return the last one."""
    for table in tables:
        publish(spark, database, table, run_id)
        drop_old_versions(spark, database, table)
    return spark.table(qualified(database, tables[-1]))


def run_direct(source: DataFrame, database: str, location: str | None = None) -> DataFrame:
    """Summarise, assert, publish."""
    spark, run_id = source.sparkSession, new_run_id()
    create_database(spark, database, location)
    try:
        name = write_version(zone_summary(source), database, SUMMARY, run_id, None, ("trip_date", "pickup_zone_id"))
        assert_all(spark.table(name), summary_assertions(SUMMARY))
    except BaseException:
        drop_unpublished(spark, database, (SUMMARY,), run_id)
        raise
    return _published(spark, database, run_id, SUMMARY)


def run_models(source: DataFrame, database: str, location: str | None = None) -> DataFrame:
    """Build each model as a table and test its columns before the next one reads it."""
    spark, run_id = source.sparkSession, new_run_id()
    create_database(spark, database, location)
    try:
        staged = spark.table(write_version(source, database, STAGED, run_id))
        _require(staged, STAGED, STAGED_TRIP_TESTS)
        name = write_version(zone_summary(staged), database, SUMMARY, run_id, None, ("trip_date", "pickup_zone_id"))
        _require(spark.table(name), SUMMARY, DAILY_SUMMARY_TESTS)
    except BaseException:
        drop_unpublished(spark, database, (STAGED, SUMMARY), run_id)
        raise
    return _published(spark, database, run_id, STAGED, SUMMARY)
