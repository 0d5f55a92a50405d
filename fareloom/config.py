"""Settings of one warehouse, as plain frozen values."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class DateWindow:
    """Calendar days, both ends included."""

    first: date
    last: date


@dataclass(frozen=True)
class TripRules:
    """Domain limits a trip has to respect."""

    lowest_zone: int = 1
    highest_zone: int = 265
    default_passengers: int = 1
    sources: tuple[str, ...] = ("batch", "stream")


# Rules that some events of every test table break.
FEWER_ZONES = TripRules(lowest_zone=8, highest_zone=200)


@dataclass(frozen=True)
class TableNames:
    """Names of the tables of each layer."""

    batch_staging: str = "stg_green_taxi_batch"
    stream_staging: str = "stg_green_taxi_stream"
    trips: str = "int_green_taxi_trips"
    trip_days: str = "int_trip_days"
    run_log: str = "run_progress"
    daily_totals: str = "int_daily_totals"
    daily_mart: str = "mart_daily_taxi_summary"
    monthly_mart: str = "mart_monthly_taxi_performance"


@dataclass(frozen=True)
class WarehouseConfig:
    """Everything a run needs to know apart from its input paths."""

    database: str
    location: str | None = None
    batch_window: DateWindow = DateWindow(date(2025, 4, 1), date(2025, 5, 31))
    stream_window: DateWindow = DateWindow(date(2025, 6, 1), date(2025, 7, 31))
    rules: TripRules = field(default_factory=TripRules)
    tables: TableNames = field(default_factory=TableNames)
    kept_versions: int = 2
    # Buckets of the key-to-day table, at least; a table of more rows than these hold has more.
    key_buckets: int = 8
    rows_per_bucket: int = 1_000_000
