"""Declared tests on single columns: not null, unique, and references to another table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnTests:
    """The tests one column has to pass."""

    column: str
    not_null: bool = False
    unique: bool = False


# The tests of the two example models.
STAGED_TRIP_TESTS = (
    ColumnTests("trip_id", not_null=True, unique=True),
    ColumnTests("trip_date", not_null=True),
    ColumnTests("total_amount", not_null=True),
)
DAILY_SUMMARY_TESTS = (
    ColumnTests("trip_date", not_null=True),
    ColumnTests("pickup_zone_id", not_null=True),
    ColumnTests("trip_count", not_null=True),
)


def not_null_failures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a value, for all columns in one scan."""
    measured = df.agg(*(F.count_if(F.col(name).isNull()).alias(name) for name in columns))
    rows = [
        F.struct(F.lit("not_null").alias("test"), F.lit(name).alias("column"), F.col(name).alias("failures"))
        for name in columns
    ]
    return measured.select(F.inline(F.array(*rows)))


def unique_failures(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once. Counts are added up before the shuffle."""
    copies = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(F.count_if(F.col("copies") > 1).alias("failures")).select(
        F.lit("unique").alias("test"), F.lit(column).alias("column"), "failures"
    )


def run_column_tests(df: DataFrame, tests: Sequence[ColumnTests]) -> DataFrame:
    """One row (test, column, failures, passed) per declared test."""
    parts = []
    required = [t.column for t in tests if t.not_null]
    if required:
        parts.append(not_null_failures(df, required))
    parts += [unique_failures(df, t.column) for t in tests if t.unique]
    report = reduce(DataFrame.unionByName, parts)
    return report.withColumn("passed", F.col("failures") == 0)


def relationship_failures(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows, per missing key, whose key the parent table does not have.

    Both sides are reduced to their keys first, so a key that many rows share crosses the
    shuffle once per task. Spark picks the join from the sizes it measures.
    """
    keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("missing_key"))
    counted = keys.agg(F.count(F.lit(1)).alias("child_rows"))
    known = parent.select(F.col(parent_column).alias("known_key")).distinct()
    return counted.join(known, F.col("missing_key") == F.col("known_key"), "left_anti")
