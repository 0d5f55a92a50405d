"""Rows written down in the program."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fareloom.contracts import ZONE_TRIP_SCHEMA

# The rows of the small summary example.
EXAMPLE_TRIPS = (
    ("trip-001", date(2026, 7, 1), 1, 15.50),
    ("trip-002", date(2026, 7, 1), 1, 22.00),
    ("trip-003", date(2026, 7, 1), 2, 18.25),
    ("trip-004", date(2026, 7, 2), 1, 12.75),
)


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def example_trips(spark: SparkSession) -> DataFrame:
    return inline_rows(spark, EXAMPLE_TRIPS, ZONE_TRIP_SCHEMA)
