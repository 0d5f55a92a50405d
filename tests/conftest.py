import os
import sys
from datetime import date, datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fareloom.config import WarehouseConfig  # noqa: E402
from fareloom.contracts import STREAM_SCHEMA, TRIP_SCHEMA  # noqa: E402
from fareloom.session import local_session  # noqa: E402

RAW_SCHEMA = (
    "lpep_pickup_datetime timestamp_ntz, lpep_dropoff_datetime timestamp_ntz, PULocationID int, DOLocationID int, "
    "passenger_count double, trip_distance double, fare_amount double, tip_amount double, tolls_amount double, "
    "total_amount double, payment_type double"
)
RAW_ROW = {
    "lpep_pickup_datetime": datetime(2025, 4, 10, 8, 0),
    "lpep_dropoff_datetime": datetime(2025, 4, 10, 8, 15),
    "PULocationID": 10,
    "DOLocationID": 20,
    "passenger_count": 2.0,
    "trip_distance": 3.5,
    "fare_amount": 12.0,
    "tip_amount": 1.0,
    "tolls_amount": 0.0,
    "total_amount": 13.0,
    "payment_type": 1.0,
}
TRIP_ROW = {
    "trip_id": "t1",
    "pickup_datetime": datetime(2025, 6, 10, 8, 0),
    "dropoff_datetime": datetime(2025, 6, 10, 8, 15),
    "pickup_date": date(2025, 6, 10),
    "pickup_location_id": 10,
    "dropoff_location_id": 20,
    "passenger_count": 2,
    "trip_distance": 3.5,
    "fare_amount": 12.0,
    "tip_amount": 1.0,
    "tolls_amount": 0.0,
    "total_amount": 13.0,
    "payment_type": 1,
    "source_type": "stream",
    "ingestion_time": datetime(2025, 8, 1),
}


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _rows(spark, base, schema, changes):
    rows = [{**base, **change} for change in changes]
    names = [f.name for f in schema.fields] if hasattr(schema, "fields") else list(base)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


@pytest.fixture
def raw(spark):
    """Raw monthly rows: one per dict of changes to a good row."""
    return lambda *changes: _rows(spark, RAW_ROW, RAW_SCHEMA, changes)


@pytest.fixture
def trip(spark):
    return lambda *changes: _rows(spark, TRIP_ROW, TRIP_SCHEMA, changes)


@pytest.fixture
def event(spark):
    base = {"event_id" if k == "trip_id" else k: v for k, v in TRIP_ROW.items()}
    return lambda *changes: _rows(spark, base, STREAM_SCHEMA, changes)


@pytest.fixture
def config(spark, tmp_path):
    """A database of its own."""
    name = "db_" + "".join(c for c in tmp_path.name.lower() if c.isalnum())
    made = WarehouseConfig(database=name, location=str(tmp_path / "database"))
    from fareloom.operators.tables import create_database

    create_database(spark, made.database, made.location)
    return made
