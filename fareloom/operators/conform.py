"""Bring the monthly files and the stream to the trip contract."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.config import WarehouseConfig
from fareloom.contracts import BATCH_COLUMNS, BATCH_DAY, FINGERPRINT_COLUMNS, RAW_NAME, TRIP_SCHEMA
from fareloom.functions.scalars import fingerprint, in_window, stamp, whole_number
from fareloom.operators.rules import valid_trip


def _typed(source: Column, target: str) -> Column:
    kind = TRIP_SCHEMA[target].dataType
    return whole_number(source) if isinstance(kind, T.LongType) else source.cast(kind)


def batch_trip_id() -> Column:
    """Digest of the raw values that identify a trip."""
    return fingerprint(*(F.col(RAW_NAME[name]) for name in FINGERPRINT_COLUMNS))


def conform_batch(raw: DataFrame, config: WarehouseConfig, run_stamp: datetime | None = None) -> DataFrame:
    """Rename and cast raw rows to the contract; every row comes through."""
    columns = {c.target: _typed(F.col(c.source), c.target) for c in BATCH_COLUMNS}
    columns["trip_id"] = batch_trip_id()
    columns["pickup_date"] = F.col(RAW_NAME["pickup_datetime"]).cast("date")
    columns["passenger_count"] = F.coalesce(columns["passenger_count"], F.lit(config.rules.default_passengers))
    columns["source_type"] = F.lit("batch")
    columns["ingestion_time"] = stamp(run_stamp)
    return raw.select(*(columns[name].alias(name) for name in TRIP_SCHEMA.names))


def conform_stream(staged: DataFrame) -> DataFrame:
    """Take the event id as the trip id; the other columns already follow the contract."""
    columns = {field.name: F.col(field.name).cast(field.dataType) for field in TRIP_SCHEMA.fields[1:]}
    columns["trip_id"] = F.col("event_id")
    columns["source_type"] = F.lit("stream")
    return staged.select(*(columns[name].alias(name) for name in TRIP_SCHEMA.names))


def window_batch(raw: DataFrame, config: WarehouseConfig) -> DataFrame:
    """Raw rows picked up inside the batch window; prunes day partitions where there are any."""
    kept = raw.where(in_window(F.col(RAW_NAME["pickup_datetime"]).cast("date"), config.batch_window))
    if BATCH_DAY in raw.columns:
        kept = kept.where(in_window(F.col(BATCH_DAY), config.batch_window))
    return kept


def window_stream(staged: DataFrame, config: WarehouseConfig) -> DataFrame:
    return staged.where(in_window(F.col("pickup_date"), config.stream_window))


def valid_batch(raw: DataFrame, config: WarehouseConfig) -> DataFrame:
    return window_batch(raw, config).where(valid_trip(config.rules))


def unified_trips(
    raw: DataFrame, staged: DataFrame, config: WarehouseConfig, run_stamp: datetime | None = None
) -> DataFrame:
    """Valid batch trips and windowed stream trips under one contract."""
    batch = conform_batch(valid_batch(raw, config), config, run_stamp)
    return batch.unionByName(conform_stream(window_stream(staged, config)))
