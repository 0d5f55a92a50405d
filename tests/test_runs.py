"""Complete runs, and the contract of the entry file."""

import contextlib
import io
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from fareloom.config import DateWindow
from fareloom.oracle import all_sql
from fareloom.plans import queries
from fareloom.sources.files import read_files
from fareloom.contracts import STREAM_SCHEMA, TRIP_SCHEMA, ZONE_TRIP_SCHEMA
from fareloom.operators.gates import QualityGateError
from fareloom.operators.marts import daily_mart, daily_totals, monthly_mart, zone_summary
from fareloom.operators.tables import day_folders, qualified, versions
from fareloom.plans import taxi_warehouse
from fareloom.plans.zone_summary import run_direct, run_models
from fareloom.sources.inline import example_trips, inline_rows
from fareloom.streaming.ingest import ingest_events, register_staged

FOLDER = "/root/testdata/sf0.001"
STAMP = datetime(2025, 8, 1)
EXAMPLE_RESULT = [
    (date(2026, 7, 1), 1, 2, 37.5),
    (date(2026, 7, 1), 2, 1, 18.25),
    (date(2026, 7, 2), 1, 1, 12.75),
]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def summary(df):
    return rows(df.select("trip_date", "pickup_zone_id", "trip_count", "total_revenue"))


def test_inline_rows_in_both_spellings(spark):
    sql = spark.sql("""
        SELECT inline(array(
          named_struct('trip_id', 'trip-001', 'trip_date', DATE '2026-07-01', 'pickup_zone_id', 1,
                       'total_amount', CAST(15.50 AS DOUBLE)),
          named_struct('trip_id', 'trip-002', 'trip_date', DATE '2026-07-01', 'pickup_zone_id', 1,
                       'total_amount', CAST(22.00 AS DOUBLE))))""")
    assert rows(sql) == rows(example_trips(spark).where("trip_id < 'trip-003'"))


def test_zone_summary_of_the_example(spark):
    assert rows(zone_summary(example_trips(spark))) == EXAMPLE_RESULT


def test_direct_and_model_runs_publish_the_same_summary(spark, config):
    trips = example_trips(spark)
    for run in (run_direct, run_models):
        for _ in range(2):
            assert summary(run(trips, config.database)) == EXAMPLE_RESULT


def test_a_failing_assertion_keeps_the_published_summary(spark, config):
    run_direct(example_trips(spark), config.database)
    bad = inline_rows(spark, [("x", date(2026, 7, 3), 1, -5.0)], ZONE_TRIP_SCHEMA)
    with pytest.raises(QualityGateError, match="a summary row without trips or with negative revenue"):
        run_direct(bad, config.database)
    assert summary(spark.table(qualified(config.database, "daily_trip_summary"))) == EXAMPLE_RESULT


def test_a_failing_column_test_stops_before_the_next_model(spark, config):
    bad = inline_rows(spark, [("x", date(2026, 7, 3), 1, 5.0), ("x", None, 1, 5.0)], ZONE_TRIP_SCHEMA)
    with pytest.raises(QualityGateError) as error:
        run_models(bad, config.database)
    assert {"unique stg_trips.trip_id: 1", "not_null stg_trips.trip_date: 1"} == set(str(error.value).split("; "))
    assert versions(spark, config.database, "daily_trip_summary") == []


def test_marts_by_hand(trip):
    june, july = date(2025, 6, 10), date(2025, 7, 1)
    trips = trip(
        {"total_amount": 10.0, "trip_distance": 1.0},
        {"total_amount": 5.01, "trip_distance": 2.0, "dropoff_datetime": datetime(2025, 6, 10, 8, 0, 30)},
        {"total_amount": 1.0, "trip_distance": None, "dropoff_datetime": None, "source_type": "batch"},
        {
            "pickup_date": july,
            "total_amount": 2.0,
            "trip_distance": 4.0,
        },
    )
    totals = daily_totals(trips)
    assert {(r[0], r[1]): tuple(r[2:]) for r in daily_mart(totals).collect()} == {
        (june, "stream"): (2, 15.01, 7.51, 1.5, 7.75),
        (june, "batch"): (1, 1.0, 1.0, None, None),
        (july, "stream"): (1, 2.0, 2.0, 4.0, 15.0),
    }
    assert {(r[0], r[1]): tuple(r[2:]) for r in monthly_mart(totals).collect()} == {
        (date(2025, 6, 1), "stream"): (2, 15.01, 7.51, 1.5),
        (date(2025, 6, 1), "batch"): (1, 1.0, 1.0, None),
        (date(2025, 7, 1), "stream"): (1, 2.0, 2.0, 4.0),
    }


@pytest.fixture
def inputs(spark, raw, event, config, tmp_path):
    """Two monthly files and a staged stream; returns the files."""
    files = [str(tmp_path / "april"), str(tmp_path / "may")]
    raw({}, {}, {"fare_amount": -1.0}).write.parquet(files[0])
    raw({"lpep_pickup_datetime": datetime(2025, 5, 2), "lpep_dropoff_datetime": datetime(2025, 5, 2, 1)}).write.parquet(
        files[1]
    )
    event({"event_id": "a"}, {"event_id": "a", "ingestion_time": datetime(2025, 8, 2)}).write.parquet(
        str(tmp_path / "events")
    )
    target = str(tmp_path / "stream")
    ingest_events(spark, str(tmp_path / "events"), STREAM_SCHEMA, target, str(tmp_path / "progress"))
    register_staged(spark, config.database, config.tables.stream_staging, target)
    return files


def test_a_run_publishes_every_layer(spark, config, inputs):
    results = taxi_warehouse.run(spark, config, inputs, STAMP)
    assert [r.gate for r in results][:2] == ["check_stream_data_exists", "check_batch_row_count"]
    assert len(results) == 8 and all(r.passed for r in results)
    table = lambda name: spark.table(qualified(config.database, name))
    trips = table(config.tables.trips)
    assert set(trips.columns) == set(TRIP_SCHEMA.names)
    assert rows(trips.select("pickup_date", "source_type", "ingestion_time")) == [
        (date(2025, 4, 10), "batch", STAMP),
        (date(2025, 5, 2), "batch", STAMP),
        (date(2025, 6, 10), "stream", datetime(2025, 8, 2)),
    ]
    assert table(config.tables.daily_mart).count() == 3
    assert table(config.tables.monthly_mart).count() == 3


def test_running_again_leaves_the_same_rows(spark, config, inputs):
    seen = []
    for _ in range(3):
        taxi_warehouse.run(spark, config, inputs, STAMP)
        names = (config.tables.trips, config.tables.daily_mart, config.tables.monthly_mart)
        seen.append([rows(spark.table(qualified(config.database, n))) for n in names])
    assert seen[0] == seen[1] == seen[2]
    assert len(versions(spark, config.database, config.tables.trips)) == config.kept_versions
    assert len(versions(spark, config.database, config.tables.daily_totals)) == config.kept_versions


def test_a_failing_staging_gate_publishes_nothing(spark, config, inputs, raw, tmp_path):
    bad = str(tmp_path / "bad")
    raw({"PULocationID": None}).write.parquet(bad)
    with pytest.raises(QualityGateError, match="check_batch_required_nulls"):
        taxi_warehouse.run(spark, config, [*inputs, bad], STAMP)
    assert not spark.catalog.tableExists(qualified(config.database, config.tables.batch_staging))
    assert versions(spark, config.database, config.tables.trips) == []
    assert versions(spark, config.database, config.tables.batch_staging) == []


def test_a_failing_trip_gate_keeps_the_old_tables(spark, config, inputs, event, tmp_path):
    taxi_warehouse.run(spark, config, inputs, STAMP)
    before = rows(spark.table(qualified(config.database, config.tables.trips)))
    event({"event_id": None}, {"event_id": "b", "fare_amount": -1.0}).write.parquet(str(tmp_path / "more"))
    ingest_events(spark, str(tmp_path / "more"), STREAM_SCHEMA, str(tmp_path / "stream2"), str(tmp_path / "progress2"))
    register_staged(spark, config.database, config.tables.stream_staging, str(tmp_path / "stream2"))
    with pytest.raises(QualityGateError, match="check_duplicates, check_invalid_values"):
        taxi_warehouse.run(spark, config, inputs, datetime(2025, 9, 1))
    assert rows(spark.table(qualified(config.database, config.tables.trips))) == before
    assert len(versions(spark, config.database, config.tables.daily_mart)) == 1
    assert len(versions(spark, config.database, config.tables.trips)) == 1


def staged_again(spark, config, tmp_path, events):
    """More event files for the stream staging table of `inputs`."""
    events.write.parquet(str(tmp_path / f"events/{len(list((tmp_path / 'events').iterdir()))}.parquet"))
    ingest_events(spark, str(tmp_path / "events/*.parquet"), STREAM_SCHEMA, str(tmp_path / "again"), str(tmp_path / "progress-again"))
    register_staged(spark, config.database, config.tables.stream_staging, str(tmp_path / "again"))


JUNE = [datetime(2025, 6, d, 8) for d in range(1, 31)]


def on(day, **more):
    pickup = JUNE[day - 1]
    return {"pickup_datetime": pickup, "dropoff_datetime": pickup + timedelta(minutes=9), "pickup_date": pickup.date(), **more}


@pytest.fixture
def late(spark, config, inputs, event, tmp_path):
    """A warehouse that was run before some events came; a function stages them."""
    (tmp_path / "events").rename(tmp_path / "first-events")
    (tmp_path / "events").mkdir()
    stamps = [datetime(2025, 8, d) for d in range(1, 10)]
    staged_again(spark, config, tmp_path, event(on(1, event_id="a"), on(1, event_id="b"), on(2, event_id="c"), on(3, event_id="d"), on(4, event_id="e"), on(5, event_id="f"), on(5, event_id="g")))
    taxi_warehouse.run(spark, config, inputs, STAMP)
    newer = event(
        on(10, event_id="a", ingestion_time=stamps[3]),  # comes again on another day
        on(10, event_id="c", ingestion_time=datetime(2025, 7, 1)),  # an older copy changes nothing
        on(10, event_id="d", ingestion_time=stamps[4]),  # the third loses its only trip
        on(11, event_id="new"),
        on(11, event_id="new", ingestion_time=stamps[5], fare_amount=1.0),
        on(12, event_id="f", ingestion_time=stamps[6]),
        on(20, event_id="g", ingestion_time=stamps[7]),  # outside of the window that is rebuilt
    )
    return lambda: staged_again(spark, config, tmp_path, newer)


def published(spark, config):
    names = config.tables
    return [rows(spark.table(qualified(config.database, n)).select(*sorted(spark.table(qualified(config.database, n)).columns))) for n in (names.trips, names.daily_totals, names.daily_mart, names.monthly_mart)]


def test_rebuilt_trips_equal_a_full_run(spark, config, inputs, late):
    late()
    window = DateWindow(date(2025, 6, 9), date(2025, 6, 15))
    # The first, third and fifth day lose trips that the window takes over; the second, with an older copy, stays.
    assert taxi_warehouse.rebuild_trips(spark, config, window, STAMP) == [date(2025, 6, d) for d in (1, 3, 5, 10, 11, 12)]
    trips = spark.table(qualified(config.database, config.tables.trips))
    assert {(r.trip_id, r.pickup_date.day) for r in trips.where("source_type = 'stream'").collect()} == {("a", 10), ("b", 1), ("c", 2), ("d", 10), ("e", 4), ("f", 12), ("g", 5), ("new", 11)}
    assert taxi_warehouse.rebuild_trips(spark, config, window, STAMP) == []
    # The rest of the late events, on a day of their own.
    assert taxi_warehouse.rebuild_trips(spark, config, DateWindow(date(2025, 6, 20), date(2025, 6, 20)), STAMP) == [date(2025, 6, 5), date(2025, 6, 20)]
    rebuilt = published(spark, config)
    taxi_warehouse.run(spark, config, inputs, STAMP)
    assert rebuilt == published(spark, config)


def test_a_rebuild_writes_only_the_days_that_changed(spark, config, late):
    before = day_folders(spark.table(qualified(config.database, config.tables.trips)))
    late()
    changed = taxi_warehouse.rebuild_trips(spark, config, DateWindow(date(2025, 6, 9), date(2025, 6, 15)), STAMP)
    after = day_folders(spark.table(qualified(config.database, config.tables.trips)))
    names = {f"pickup_date={d.isoformat()}" for d in changed}
    assert {day for day, folder in after.items() if before.get(day) != folder} == names - {"pickup_date=2025-06-03"}
    assert "pickup_date=2025-06-03" in before and "pickup_date=2025-06-03" not in after
    assert len(set(after) - names) > 3


def test_a_rebuild_reads_the_window_and_the_days_of_touched_keys(spark, config, late, monkeypatch):
    """The staged tables and the trips are read with partition filters, the key table without a shuffle of its own."""
    late()
    plans = []
    kept = taxi_warehouse._kept
    monkeypatch.setattr(taxi_warehouse, "_kept", lambda df, label: (plans.append((label, explained(df))), kept(df, label))[1])
    # Tables of any real size are not broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        taxi_warehouse.rebuild_trips(spark, config, DateWindow(date(2025, 6, 9), date(2025, 6, 15)), STAMP)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = dict(plans)
    for label in ("window-copies", "touched-trips", "latest-copies", "published-copies"):
        scans = [line for line in plan[label].splitlines() if "FileScan" in line and "pickup_date" in line and "scratch" not in line]
        assert scans and all("PartitionFilters: [" in line and "PartitionFilters: []" not in line for line in scans if "int_green" in line or "stg_green" in line), label
    keys = [line for line in plan["other-days"].splitlines() if "Bucketed: true" in line]
    assert keys
    # The key table is joined where it lies: the only exchange is that of the touched keys.
    assert plan["other-days"].count("Exchange hashpartitioning") <= 1


def explained(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_a_crash_in_a_rebuild_leaves_trips_and_marts_as_they_were(spark, config, late, monkeypatch):
    late()
    before = published(spark, config)
    window = DateWindow(date(2025, 6, 9), date(2025, 6, 15))
    for step in ("write_days", "store_marts", "publish_together"):
        with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="crash"):
            patch.setattr(taxi_warehouse, step, lambda *_, **__: (_ for _ in ()).throw(RuntimeError("crash")))
            taxi_warehouse.rebuild_trips(spark, config, window, STAMP)
        assert published(spark, config) == before
        assert len(versions(spark, config.database, config.tables.trips)) == 1
    assert len(taxi_warehouse.rebuild_trips(spark, config, window, STAMP)) == 6


def test_a_rebuild_that_breaks_a_rule_publishes_nothing(spark, config, late, event, tmp_path):
    late()
    staged_again(spark, config, tmp_path, event(on(13, event_id="bad", fare_amount=-1.0)))
    before = published(spark, config)
    with pytest.raises(QualityGateError, match="check_invalid_values"):
        taxi_warehouse.rebuild_trips(spark, config, DateWindow(date(2025, 6, 9), date(2025, 6, 15)), STAMP)
    assert published(spark, config) == before


def test_a_run_goes_on_after_a_failure(spark, config, inputs, monkeypatch):
    """A failure in the marts does not stage and dedup again, and the result is that of a clean run."""
    crash = lambda *_, **__: (_ for _ in ()).throw(RuntimeError("crash"))
    names = config.tables
    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="crash"):
        patch.setattr(taxi_warehouse, "store_marts", crash)
        taxi_warehouse.run(spark, config, inputs, STAMP)
    assert not spark.catalog.tableExists(qualified(config.database, names.trips))
    kept = versions(spark, config.database, names.trips)
    assert len(kept) == 1
    with monkeypatch.context() as patch:
        for step in ("stage_batch", "keep_latest"):
            patch.setattr(taxi_warehouse, step, crash)
        resumed = taxi_warehouse.run(spark, config, inputs, STAMP)
    assert versions(spark, config.database, names.trips) == kept
    shown = published(spark, config)
    assert not spark.catalog.tableExists(qualified(config.database, names.run_log))
    assert taxi_warehouse.run(spark, config, inputs, STAMP) == resumed
    assert published(spark, config) == shown and versions(spark, config.database, names.trips) != kept


def test_a_run_with_other_inputs_starts_anew(spark, config, inputs, raw, monkeypatch):
    crash = lambda *_, **__: (_ for _ in ()).throw(RuntimeError("crash"))
    names = config.tables
    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="crash"):
        patch.setattr(taxi_warehouse, "store_marts", crash)
        taxi_warehouse.run(spark, config, inputs, STAMP)
    kept = versions(spark, config.database, names.trips)
    # The same name, other rows.
    raw({"fare_amount": 3.0}, {"total_amount": 4.0}, {"PULocationID": 7}).write.mode("overwrite").parquet(inputs[0])
    taxi_warehouse.run(spark, config, inputs, STAMP)
    assert kept[0] not in versions(spark, config.database, names.trips)
    assert spark.table(qualified(config.database, names.trips)).where("source_type = 'batch'").count() == 4


def test_no_stream_rows_in_the_window_stop_the_run(spark, config, inputs, event, tmp_path):
    event({"pickup_date": date(2025, 5, 31)}).write.parquet(str(tmp_path / "early"))
    target = str(tmp_path / "stream2")
    ingest_events(spark, str(tmp_path / "early"), STREAM_SCHEMA, target, str(tmp_path / "progress2"))
    register_staged(spark, config.database, config.tables.stream_staging, target)
    with pytest.raises(QualityGateError, match="check_stream_data_exists"):
        taxi_warehouse.run(spark, config, inputs, STAMP)


def test_an_empty_stream_stops_the_run_by_name(spark, config, inputs, tmp_path):
    register_staged(spark, config.database, config.tables.stream_staging, str(tmp_path / "nothing"))
    with pytest.raises(QualityGateError, match="check_stream_data_exists"):
        taxi_warehouse.run(spark, config, inputs, STAMP)
    assert versions(spark, config.database, config.tables.batch_staging) == []


def test_unknown_pickups_reach_their_gate_through_the_monthly_files(spark, monkeypatch):
    found = queries.raw_batch(spark, FOLDER).limit(5)
    unknown = found.withColumn("lpep_pickup_datetime", F.lit(None).cast("timestamp_ntz"))
    monkeypatch.setattr(queries, "raw_batch", lambda *_: found.unionByName(unknown))
    df = read_files(spark, queries._monthly_files(spark, FOLDER))
    assert df.count() == 10 and df.where("lpep_pickup_datetime IS NULL").count() == 5


def test_every_query_has_a_query_of_the_other_engine():
    assert set(queries.all_queries()) == set(all_sql())


def test_flagship_query(spark):
    df = driver.entry(spark)
    assert df.columns[:3] == ["pickup_date", "source_type", "trip_count"]
    assert df.agg(F.count("*"), F.sum("trip_count")).first() == (117, 4064)


def test_the_key_table_has_buckets_for_its_rows(spark, config, inputs, late):
    """More staged rows make more buckets, and later pairs are added to as many."""
    late()
    small = replace(config, key_buckets=2, rows_per_bucket=3)
    window = DateWindow(date(2025, 6, 9), date(2025, 6, 15))
    assert taxi_warehouse.rebuild_trips(spark, small, window, STAMP) == [date(2025, 6, d) for d in (1, 3, 5, 10, 11, 12)]
    staged = sum(spark.table(qualified(config.database, n)).count() for n in (config.tables.batch_staging, config.tables.stream_staging))
    keys = taxi_warehouse.trip_days(spark, small)
    assert taxi_warehouse._buckets(spark, keys) == max(2, -(-staged // 3)) > 2
    pairs = spark.table(keys)
    assert pairs.count() == pairs.distinct().count() > 0


def test_differing_rows_are_those_that_one_table_has_more_often(spark):
    table = lambda *rows: spark.createDataFrame(rows, "pickup_date date, x double")
    day, nan = date(2025, 6, 1), float("nan")
    a = table((day, 1.0), (day, 1.0), (day, None), (None, 2.0), (day, nan))
    b = table((day, 1.0), (day, None), (day, 3.0), (day, nan))
    found = taxi_warehouse._differing(a, b)
    assert explained(found).count("Exchange") == 1
    assert found.columns == ["pickup_date", "x"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [(day, 1.0), (None, 2.0), (day, 3.0)]))
