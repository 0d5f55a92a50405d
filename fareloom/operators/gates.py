"""Quality gates: what is measured, when it passes, and how a failure stops a run.

Gates that only count rows of the same table share one aggregate over one scan, or none: their numbers can be
observed while the table is written (`measures`, `judged`). A gate on distinct keys has a scan of its own, because it has to
shuffle the keys and the other gates' columns need not travel with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fareloom.config import DateWindow, TripRules
from fareloom.contracts import REQUIRED_BATCH_COLUMNS, TRIP_SCHEMA
from fareloom.functions.scalars import in_window
from fareloom.operators.rules import broken_trip


class QualityGateError(Exception):
    """At least one gate did not pass."""


@dataclass(frozen=True)
class Gate:
    """A number taken over a table and the condition on it."""

    name: str
    observed: Column
    passes: Callable[[Column], Column]


def _none(observed: Column) -> Column:
    return observed == 0


def _some(observed: Column) -> Column:
    return observed > 0


def any_null(columns: Iterable[str]) -> Column:
    return reduce(lambda left, right: left | right, (F.col(name).isNull() for name in columns))


def has_rows(name: str) -> Gate:
    return Gate(name, F.count(F.lit(1)), _some)


def has_values(name: str, columns: Iterable[str] = REQUIRED_BATCH_COLUMNS) -> Gate:
    return Gate(name, F.count_if(any_null(columns)), _none)


def has_valid_values(name: str, rules: TripRules) -> Gate:
    return Gate(name, F.count_if(broken_trip(rules)), _none)


def has_unique_key(name: str, key: str = "trip_id") -> Gate:
    """Rows minus distinct keys; an unknown key is no key, so it fails too."""
    return Gate(name, F.count(F.lit(1)) - F.count_distinct(F.col(key)), _none)


def stream_rows(staged: DataFrame, window: DateWindow) -> DataFrame:
    """Rows the stream delivered for a window; a filter, so only the window's partitions are read."""
    return staged.where(in_window(F.col("pickup_date"), window) & (F.col("source_type") == "stream"))


def measures(gates: Sequence[Gate]) -> list[Column]:
    """The numbers of some gates, to be observed while their table is written."""
    return [gate.observed.cast("bigint").alias(gate.name) for gate in gates]


def judged(gates: Sequence[Gate], measured: Mapping[str, int | None]) -> list[Row]:
    """The rows of `evaluate`, from numbers that have been measured already; an unknown number does not pass."""
    return [Row(gate=g.name, observed=measured.get(g.name), passed=measured.get(g.name) is not None and bool(g.passes(measured[g.name]))) for g in gates]


def evaluate(df: DataFrame, *gates: Gate) -> DataFrame:
    """One row (gate, observed, passed) per gate, all from one aggregate over `df`."""
    measured = df.agg(*measures(gates))
    rows = [
        F.struct(
            F.lit(gate.name).alias("gate"),
            F.col(gate.name).alias("observed"),
            F.coalesce(gate.passes(F.col(gate.name)), F.lit(False)).alias("passed"),
        )
        for gate in gates
    ]
    return measured.select(F.inline(F.array(*rows)))


def evaluate_columns(
    spark: SparkSession, name: str, table: str, expected: Sequence[str] = tuple(TRIP_SCHEMA.names)
) -> DataFrame:
    """How many of the expected column names the catalog lists for a table; types are not compared."""
    present = {column.name for column in spark.catalog.listColumns(table)}
    found = len(present.intersection(expected))
    return spark.range(1).select(
        F.lit(name).alias("gate"),
        F.lit(found).cast("bigint").alias("observed"),
        F.lit(found == len(expected)).alias("passed"),
    )


def require(*reports: DataFrame | Sequence[Row]) -> list[Row]:
    """The rows of gate reports, or an error that names every gate that failed."""
    rows = [row for report in reports for row in (report.collect() if isinstance(report, DataFrame) else report)]
    failed = [row["gate"] for row in rows if not row["passed"]]
    if failed:
        raise QualityGateError("failed quality gates: " + ", ".join(sorted(failed)))
    return rows


@dataclass(frozen=True)
class Assertion:
    """A condition over a whole table and what to say when it does not hold."""

    message: str
    holds: Column


def summary_assertions(table: str = "daily_trip_summary") -> list[Assertion]:
    invalid = (F.col("trip_count") <= 0) | (F.col("total_revenue") < 0)
    return [
        Assertion(f"no rows in {table}", F.count(F.lit(1)) > 0),
        Assertion("a summary row without trips or with negative revenue", F.count_if(invalid) == 0),
    ]


def check_assertions(df: DataFrame, assertions: Sequence[Assertion]) -> DataFrame:
    """One row (position, message, holds) per assertion, from one aggregate."""
    measured = df.agg(*(a.holds.alias(f"a{i}") for i, a in enumerate(assertions)))
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(a.message).alias("message"),
            F.coalesce(F.col(f"a{i}"), F.lit(False)).alias("holds"),
        )
        for i, a in enumerate(assertions)
    ]
    return measured.select(F.inline(F.array(*rows)))


def assert_all(df: DataFrame, assertions: Sequence[Assertion]) -> None:
    """Raise with the message of the first assertion, in their order, that does not hold."""
    for row in sorted(check_assertions(df, assertions).collect(), key=lambda r: r["position"]):
        if not row["holds"]:
            raise QualityGateError(row["message"])
