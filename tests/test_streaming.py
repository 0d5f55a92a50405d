"""Bounded stream ingestion."""

import os
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from fareloom.config import TripRules
from fareloom.contracts import STREAM_SCHEMA
from fareloom.operators.tables import qualified
from fareloom.streaming import ingest as module
from fareloom.streaming.ingest import committed_batches, ingest_events, read_rejected, read_staged, register_staged, without_broken, write_batch


def ingest(spark, tmp_path, **options):
    ingest_events(
        spark,
        str(tmp_path / "in"),
        STREAM_SCHEMA,
        str(tmp_path / "out"),
        str(tmp_path / "progress"),
        **options,
    )


def ids(spark, tmp_path):
    return sorted(r["event_id"] for r in read_staged(spark, str(tmp_path / "out")).collect())


def test_a_second_run_adds_nothing(spark, event, tmp_path):
    event({"event_id": "a"}, {"event_id": "b"}).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, tmp_path)
    assert ids(spark, tmp_path) == ["a", "b"]


def test_new_files_are_appended_once(spark, event, tmp_path):
    event({"event_id": "a"}).write.parquet(str(tmp_path / "in"))
    ingest(spark, tmp_path)
    event({"event_id": "b"}, {"event_id": "a"}).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(spark, tmp_path)
    # Copies are kept here; the latest one is chosen later, by key.
    assert ids(spark, tmp_path) == ["a", "a", "b"]


def test_a_backlog_is_worked_off_in_bounded_batches(spark, event, tmp_path):
    event(*({"event_id": f"e{i}"} for i in range(6))).repartition(3).write.parquet(str(tmp_path / "in"))
    ingest(spark, tmp_path, bytes_per_batch=1)
    assert len(list((tmp_path / "progress" / "commits").glob("[0-9]*"))) == 3
    assert len(ids(spark, tmp_path)) == 6


def test_a_failed_run_resumes_without_copies(spark, event, tmp_path):
    event(*({"event_id": f"e{i}"} for i in range(4))).repartition(2).write.parquet(str(tmp_path / "in"))

    def breaks(events):
        broken = F.when(F.col("event_id") == "e3", F.raise_error("broken").cast("string"))
        return events.withColumn("event_id", F.coalesce(broken, "event_id"))

    try:
        ingest(spark, tmp_path, prepare=breaks, bytes_per_batch=1)
    except Exception as error:
        assert "broken" in str(error)
    ingest(spark, tmp_path, bytes_per_batch=1)
    assert ids(spark, tmp_path) == ["e0", "e1", "e2", "e3"]


def test_broken_events_can_be_left_out(spark, event, tmp_path):
    event({"event_id": "a"}, {"event_id": "b", "total_amount": 0.0}, {"event_id": "c", "trip_distance": None}).write.parquet(
        str(tmp_path / "in")
    )
    ingest(spark, tmp_path, prepare=lambda events: without_broken(events, TripRules()))
    # An unknown value breaks no rule.
    assert ids(spark, tmp_path) == ["a", "c"]


def test_values_are_cast_to_the_contract(spark, event, tmp_path):
    narrow = event({"passenger_count": 3}).withColumn("passenger_count", F.col("passenger_count").cast("int"))
    narrow.write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    ingest_events(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "progress"))
    df = read_staged(spark, str(tmp_path / "out"))
    assert df.schema["passenger_count"].dataType.simpleString() == "bigint"


def test_staged_files_become_a_table_with_pruned_days(spark, event, tmp_path, config, capsys):
    event({"event_id": "a"}, {"event_id": "b", "pickup_date": date(2025, 7, 1)}).write.parquet(str(tmp_path / "in"))
    ingest(spark, tmp_path)
    df = spark.table(register_staged(spark, config.database, "stream", str(tmp_path / "out")))
    july = df.where("pickup_date = DATE '2025-07-01'")
    capsys.readouterr()
    july.explain()
    filters = capsys.readouterr().out.split("PartitionFilters: [")[1].split("]")[0]
    assert "outcome" in filters and "(pickup_date" in filters
    assert [r["event_id"] for r in july.collect()] == ["b"]


def test_old_files_are_new_too(spark, event, tmp_path):
    def add(name, days_old):
        event({"event_id": name}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        path = max((p for p in (tmp_path / "in").glob("*.parquet")), key=lambda p: p.stat().st_ctime_ns)
        os.utime(path, (time.time() - days_old * 86400,) * 2)

    add("now", 0)
    ingest(spark, tmp_path)
    add("ten days", 10)
    add("ten years", 3650)
    ingest(spark, tmp_path)
    ingest(spark, tmp_path)
    assert ids(spark, tmp_path) == ["now", "ten days", "ten years"]


def test_files_do_not_multiply_with_tasks(spark, event, tmp_path):
    event(*({"event_id": f"e{i}", "pickup_date": date(2025, 6, 1 + i % 2)} for i in range(40))).repartition(8).write.parquet(str(tmp_path / "in"))
    ingest(spark, tmp_path)
    assert len(list((tmp_path / "out").glob("batch=*/outcome=*/pickup_date=*/*.parquet"))) <= 4
    assert len(ids(spark, tmp_path)) == 40


def test_a_repeated_batch_adds_nothing(spark, event, tmp_path):
    for name in ("a", "b"):
        write_batch(event({"event_id": name}), str(tmp_path / "out"), "0")
    # What is in the log is not written again.
    assert ids(spark, tmp_path) == ["a"]


def test_a_batch_is_read_when_it_is_in_the_log(spark, event, config, tmp_path, monkeypatch):
    """A batch that breaks after some of its files, or after all of them, is not read, and comes as a whole when it is repeated."""
    target = str(tmp_path / "out")
    write_batch(event({"event_id": "a"}), target, "0")
    broken = event({"event_id": "b"}, {"event_id": "c", "pickup_date": date(2025, 6, 11)})
    halves = broken.withColumn("fare_amount", F.when(F.col("event_id") == "c", F.raise_error("broken").cast("double")).otherwise(F.col("fare_amount")))
    table = lambda: sorted(r["event_id"] for r in spark.table(register_staged(spark, config.database, "stream", target)).collect())
    for rows, crash in ((halves, False), (broken, True)):
        with monkeypatch.context() as patch, pytest.raises(Exception, match="broken|crash"):
            if crash:
                patch.setattr(module, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
            write_batch(rows, target, "1")
        assert ids(spark, tmp_path) == table() == ["a"]
    assert (tmp_path / "out/batch=1").exists() and committed_batches(spark, target) == ["0"]
    write_batch(broken, target, "1")
    assert ids(spark, tmp_path) == table() == ["a", "b", "c"]


def test_registering_again_looks_at_new_batches_only(spark, event, config, tmp_path, monkeypatch):
    target, asked, listed = str(tmp_path / "out"), [], module._partitions
    monkeypatch.setattr(module, "_partitions", lambda s, t, names: (asked.append(names), listed(s, t, names))[1])
    for n in range(3):
        write_batch(event({"event_id": f"e{n}", "pickup_date": date(2025, 6, 1 + n)}, {"event_id": "x", "pickup_date": None}), target, str(n))
        found = spark.table(register_staged(spark, config.database, "stream", target))
        assert found.count() == 2 * (n + 1) and found.where("pickup_date IS NULL").count() == n + 1
    assert asked == [["0"], ["1"], ["2"]]
    # Another folder is another table.
    write_batch(event({"event_id": "other"}), str(tmp_path / "out2"), "0")
    assert [r["event_id"] for r in spark.table(register_staged(spark, config.database, "stream", str(tmp_path / "out2"))).collect()] == ["other"]


def test_two_checkpoints_share_a_target(spark, event, tmp_path):
    """Both begin with batch number 0; neither takes the place of the other."""
    for name in ("a", "b"):
        event({"event_id": name}).write.parquet(str(tmp_path / name))
        ingest_events(spark, str(tmp_path / name), STREAM_SCHEMA, str(tmp_path / "out"), str(tmp_path / f"progress-{name}"))
    assert ids(spark, tmp_path) == ["a", "b"]


def test_rejected_events_are_set_aside(spark, event, config, tmp_path):
    """Staged and rejected events are those read, batch by batch, also when a batch is repeated."""
    good = [{"event_id": f"g{i}"} for i in range(3)] + [{"event_id": "unknown", "trip_distance": None}]
    bad = [{"event_id": "zone", "pickup_location_id": 0}, {"event_id": "fare", "fare_amount": -1.0, "total_amount": -1.0}, {"event_id": "day", "pickup_date": None, "source_type": "other"}]
    event(*good, *bad).repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, tmp_path, rules=TripRules(), bytes_per_batch=1)
    rejected = read_rejected(spark, str(tmp_path / "out"))
    assert ids(spark, tmp_path) == sorted(g["event_id"] for g in good)
    assert {r["event_id"]: r["broken_rule"] for r in rejected.collect()} == {"zone": "pickup zone", "fare": "fare not below zero", "day": "source"}
    read = spark.read.parquet(str(tmp_path / "in")).count()
    assert ids(spark, tmp_path).__len__() + rejected.count() == read
    assert set(r["batch"] for r in rejected.collect()) <= set(committed_batches(spark, str(tmp_path / "out")))
    table = spark.table(register_staged(spark, config.database, "stream", str(tmp_path / "out")))
    assert sorted(r["event_id"] for r in table.collect()) == ids(spark, tmp_path)
    files = spark.table(qualified(config.database, "stream__files"))
    assert files.where("outcome = 'rejected'").count() == 3
