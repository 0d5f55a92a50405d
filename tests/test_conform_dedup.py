"""From raw rows to the latest copy of each trip."""

from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import RAW_ROW
from fareloom.config import WarehouseConfig
from fareloom.contracts import TRIP_SCHEMA
from fareloom.operators.conform import (
    conform_batch,
    conform_stream,
    unified_trips,
    valid_batch,
    window_batch,
    window_stream,
)
from fareloom.operators.dedup import keep_latest

CONFIG = WarehouseConfig(database="unused")
STAMP = datetime(2025, 8, 1)


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def test_batch_follows_the_contract(raw):
    df = conform_batch(raw({}), CONFIG, STAMP)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in TRIP_SCHEMA]
    row = df.first()
    assert (row["source_type"], row["ingestion_time"], row["pickup_date"]) == ("batch", STAMP, date(2025, 4, 10))


def test_stream_follows_the_contract(event):
    df = conform_stream(event({"event_id": "e9"}))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in TRIP_SCHEMA]
    assert df.first()["trip_id"] == "e9"


def test_passengers_default_and_round(raw):
    df = conform_batch(raw({"passenger_count": None}, {"passenger_count": 2.5}), CONFIG, STAMP)
    assert [r["passenger_count"] for r in df.collect()] == [1, 3]


def test_stream_passengers_pass_through(event):
    assert conform_stream(event({"passenger_count": None})).first()["passenger_count"] is None


def test_fare_is_not_part_of_the_identity(raw):
    rows = conform_batch(raw({}, {"fare_amount": 1.0}, {"total_amount": 14.0}), CONFIG, STAMP).collect()
    assert rows[0]["trip_id"] == rows[1]["trip_id"] != rows[2]["trip_id"]


@pytest.mark.parametrize(
    "change",
    [
        {"lpep_dropoff_datetime": RAW_ROW["lpep_pickup_datetime"]},
        {"lpep_dropoff_datetime": None},
        {"PULocationID": 0},
        {"PULocationID": 266},
        {"DOLocationID": 0},
        {"DOLocationID": 266},
        {"DOLocationID": None},
        {"trip_distance": 0.0},
        {"trip_distance": float("nan")},
        {"fare_amount": -0.01},
        {"fare_amount": float("nan")},
        {"total_amount": 0.0},
        {"total_amount": None},
    ],
)
def test_each_rule_drops_its_row(raw, change):
    assert valid_batch(raw({}, change), CONFIG).count() == 1


@pytest.mark.parametrize(
    "change",
    [{"PULocationID": 1}, {"DOLocationID": 265}, {"fare_amount": 0.0}, {"trip_distance": 0.01}],
)
def test_limits_belong_to_the_domain(raw, change):
    assert valid_batch(raw(change), CONFIG).count() == 1


def test_batch_window_is_inclusive(raw):
    moments = [
        datetime(2025, 3, 31, 23, 59, 59),
        datetime(2025, 4, 1),
        datetime(2025, 5, 31, 23, 59, 59),
        datetime(2025, 6, 1),
    ]
    df = window_batch(raw(*({"lpep_pickup_datetime": m} for m in moments)), CONFIG)
    assert sorted(r["lpep_pickup_datetime"] for r in df.collect()) == moments[1:3]


def test_stream_window_is_inclusive(event):
    days = [date(2025, 5, 31), date(2025, 6, 1), date(2025, 7, 31), date(2025, 8, 1)]
    df = window_stream(event(*({"pickup_date": d} for d in days)), CONFIG)
    assert sorted(r["pickup_date"] for r in df.collect()) == days[1:3]


def test_union_stays_zone_free_in_any_session_zone(spark, raw, event):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = unified_trips(raw({}), event({}), CONFIG, STAMP)
        assert df.schema["pickup_datetime"].dataType.simpleString() == "timestamp_ntz"
        got = {r["source_type"]: r["pickup_datetime"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {"batch": datetime(2025, 4, 10, 8), "stream": datetime(2025, 6, 10, 8)}


def test_union_does_not_depend_on_column_order(raw, event):
    shuffled = event({}).select(*sorted(event({}).columns))
    df = unified_trips(raw({}), shuffled, CONFIG, STAMP)
    assert df.where("source_type = 'stream'").first()["fare_amount"] == 12.0


def test_filters_and_columns_reach_the_scan(spark, raw, tmp_path, capsys):
    path = str(tmp_path / "raw")
    raw({}).withColumn("unused", F.lit(1)).write.parquet(path)
    text = plan(conform_batch(valid_batch(spark.read.parquet(path), CONFIG), CONFIG, STAMP), capsys)
    pushed = next(line for line in text.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(lpep_pickup_datetime,2025-04-01T00:00)" in pushed
    assert "LessThan(lpep_pickup_datetime,2025-06-01T00:00)" in pushed
    assert "GreaterThan(trip_distance,0.0)" in pushed and "LessThanOrEqual(PULocationID,265)" in pushed
    assert "unused" not in next(line for line in text.splitlines() if line.startswith("ReadSchema"))


def test_latest_copy_wins(trip):
    df = keep_latest(
        trip(
            {"ingestion_time": datetime(2025, 8, 1), "fare_amount": 1.0},
            {"ingestion_time": datetime(2025, 8, 3), "fare_amount": 3.0},
            {"ingestion_time": datetime(2025, 8, 2), "fare_amount": 2.0},
            {"ingestion_time": None, "fare_amount": 0.0},
            {"trip_id": "t2"},
        )
    )
    assert sorted((r["trip_id"], r["fare_amount"]) for r in df.collect()) == [("t1", 3.0), ("t2", 12.0)]
    assert df.columns == TRIP_SCHEMA.names


@pytest.mark.parametrize("order", [1, -1])
def test_ties_are_settled_by_value_with_unknown_last(trip, order):
    copies = [{"fare_amount": None}, {"fare_amount": 5.0, "tip_amount": None}, {"fare_amount": 5.0, "tip_amount": 2.0}]
    kept = keep_latest(trip(*copies[::order])).collect()
    assert [(r["fare_amount"], r["tip_amount"]) for r in kept] == [(5.0, 2.0)]


COPIES = st.lists(
    st.tuples(
        st.sampled_from(["a", "b", None]),
        st.sampled_from([1, 2, None]),
        st.sampled_from([1.5, 2.5, None]),
        st.sampled_from([7, 8, None]),
    ),
    min_size=1,
    max_size=12,
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(COPIES)
def test_kept_copies_equal_a_plain_search(spark, copies):
    def rank(row):
        key, latest, first, second = row
        newest = (latest is None, -(latest or 0))
        return newest, (first is None, first or 0), (second is None, second or 0)

    expected = {key: min((r for r in copies if r[0] == key), key=rank) for key in {r[0] for r in copies}}
    df = spark.createDataFrame(copies, "k string, t int, x double, y int").repartition(3)
    kept = keep_latest(df, "k", "t", ("x", "y")).collect()
    assert len(kept) == len(expected)
    assert {r["k"]: tuple(r) for r in kept} == expected


def test_unknown_ids_collapse_to_one_row(trip):
    df = keep_latest(trip({"trip_id": None}, {"trip_id": None, "fare_amount": 1.0}, {}))
    assert sorted(str(r["trip_id"]) for r in df.collect()) == ["None", "t1"]


def test_a_hot_key_is_reduced_before_the_shuffle(spark, capsys):
    """A third of all rows are copies of one trip."""
    rows = spark.range(0, 30000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("t"),
        (F.col("id") % 11).alias("v"),
    )
    df = keep_latest(rows, "k", "t", ("v",))
    text = plan(df, capsys)
    exchange = text.index("Exchange")
    assert text.index("WindowGroupLimit") < exchange < text.rindex("+- WindowGroupLimit", 0, text.index("(1)", exchange))
    kept = df.collect()
    assert len(kept) == 20001
    assert next(r["t"] for r in kept if r["k"] == "hot") == 29997
