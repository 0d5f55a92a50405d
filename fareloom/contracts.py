"""Column contracts of the trip tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Names and types every consumer of the trip table relies on.
TRIP_SCHEMA = T.StructType(
    [
        T.StructField("trip_id", T.StringType()),
        T.StructField("pickup_datetime", T.TimestampNTZType()),
        T.StructField("dropoff_datetime", T.TimestampNTZType()),
        T.StructField("pickup_date", T.DateType()),
        T.StructField("pickup_location_id", T.LongType()),
        T.StructField("dropoff_location_id", T.LongType()),
        T.StructField("passenger_count", T.LongType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("tolls_amount", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("payment_type", T.LongType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("ingestion_time", T.TimestampNTZType()),
    ]
)

# The stream staging table is the trip contract with the event's own key.
STREAM_SCHEMA = T.StructType([T.StructField("event_id", T.StringType())] + TRIP_SCHEMA.fields[1:])

# The rows of the small summary example.
ZONE_TRIP_SCHEMA = T.StructType(
    [
        T.StructField("trip_id", T.StringType()),
        T.StructField("trip_date", T.DateType()),
        T.StructField("pickup_zone_id", T.IntegerType()),
        T.StructField("total_amount", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Mapped:
    """One contract column and the raw column it is made from."""

    target: str
    source: str


# Raw names of the monthly files next to the contract names.
BATCH_COLUMNS = (
    Mapped("pickup_datetime", "lpep_pickup_datetime"),
    Mapped("dropoff_datetime", "lpep_dropoff_datetime"),
    Mapped("pickup_location_id", "PULocationID"),
    Mapped("dropoff_location_id", "DOLocationID"),
    Mapped("passenger_count", "passenger_count"),
    Mapped("trip_distance", "trip_distance"),
    Mapped("fare_amount", "fare_amount"),
    Mapped("tip_amount", "tip_amount"),
    Mapped("tolls_amount", "tolls_amount"),
    Mapped("total_amount", "total_amount"),
    Mapped("payment_type", "payment_type"),
)

RAW_NAME = {column.target: column.source for column in BATCH_COLUMNS}

# What identifies a batch trip, in the order in which it enters the digest.
FINGERPRINT_COLUMNS = (
    "pickup_datetime",
    "dropoff_datetime",
    "pickup_location_id",
    "dropoff_location_id",
    "trip_distance",
    "total_amount",
)

# Raw columns without which a monthly file is refused.
REQUIRED_BATCH_COLUMNS = tuple(RAW_NAME[name] for name in FINGERPRINT_COLUMNS[:4])

# The staging table of the monthly files: partition column and clustering.
BATCH_DAY = "lpep_pickup_date"
BATCH_CLUSTER = (RAW_NAME["pickup_location_id"], RAW_NAME["payment_type"])
TRIP_CLUSTER = ("source_type", "pickup_location_id", "payment_type")

# Copies with the same ingestion time are ordered by their own values, so that
# every run keeps the same one. Copies tied on all of these are the same row.
TIE_BREAK = (
    "fare_amount",
    "tip_amount",
    "tolls_amount",
    "passenger_count",
    "payment_type",
    "pickup_datetime",
    "dropoff_datetime",
    "trip_distance",
    "total_amount",
    "pickup_location_id",
    "dropoff_location_id",
    "pickup_date",
    "source_type",
)
