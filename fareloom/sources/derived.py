"""Trips derived from the driver's order lines and events.

The test tables hold no trips. This fixed mapping makes raw monthly rows
from `lineitem` and raw stream events from `events`, with duplicates, missing values and
rows that break every rule. It is a projection: no shuffle, and only the columns it
needs are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_PICKUP = "TIMESTAMP_NTZ '2025-03-25 00:00:00'"
FIRST_INGESTION = "TIMESTAMP_NTZ '2025-08-01 00:00:00'"

EVENT_COLUMNS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _select(df: DataFrame, **columns: str | Column) -> DataFrame:
    return df.select(
        *((F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items())
    )


def raw_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pickup = f"timestampadd(MINUTE, l_orderkey * 97 % 108000, {FIRST_PICKUP})"
    dropoff = f"timestampadd(MINUTE, l_orderkey * 97 % 108000 + (l_orderkey * 11 + l_linenumber) % 90 - 2, {FIRST_PICKUP})"
    return _select(
        lines,
        lpep_pickup_datetime=pickup,
        lpep_dropoff_datetime=dropoff,
        PULocationID="cast(l_orderkey % 270 as int)",
        DOLocationID="cast((l_orderkey * 7 + l_linenumber) % 270 as int)",
        passenger_count="if(l_linenumber = 7, null, l_quantity)",
        trip_distance="cast(l_orderkey * l_linenumber % 200 - 5 as double) / 10",
        fare_amount="l_extendedprice / 1000 - 2",
        tip_amount="l_discount * 10",
        tolls_amount="l_tax * 10",
        total_amount="cast((l_orderkey * 13 + l_linenumber) % 10000 - 100 as double) / 100",
        payment_type="cast(l_linenumber as double)",
    )


def _event_pickup() -> Column:
    return F.expr("timestampadd(DAY, 517 + 35 * (event_id % 2), ts)")


def event_day() -> Column:
    """The pickup day that an event will have as a trip."""
    return _event_pickup().cast("date")


def stream_events(events: DataFrame) -> DataFrame:
    """Works on a static and on a streaming table alike."""
    shifted = events.withColumn("pickup", _event_pickup())
    return _select(
        shifted,
        event_id="concat('evt-', event_id div 10 * 9 + least(event_id % 10, 8))",
        pickup_datetime="pickup",
        dropoff_datetime="timestampadd(MILLISECOND, (user_id + 1) * 10000 + event_id % 3 * 500, pickup)",
        pickup_date="cast(pickup as date)",
        pickup_location_id="user_id % 265 + 1",
        dropoff_location_id="user_id * 7 % 265 + 1",
        passenger_count="event_id % 5",
        trip_distance="value / 25 + cast(0.01 as double)",
        fare_amount="value",
        tip_amount="cast(0 as double)",
        tolls_amount="cast(0 as double)",
        total_amount="value",
        payment_type="event_id % 6",
        source_type="'stream'",
        ingestion_time=f"timestampadd(MINUTE, event_id, {FIRST_INGESTION})",
    )


def raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def zone_trips(raw: DataFrame, trip_id: Column) -> DataFrame:
    """Raw monthly rows in the shape of the small summary example."""
    return raw.select(
        trip_id.alias("trip_id"),
        F.col("lpep_pickup_datetime").cast("date").alias("trip_date"),
        F.col("PULocationID").alias("pickup_zone_id"),
        "total_amount",
    )
