"""The command line."""

from datetime import date, datetime

import pytest

from fareloom.config import DateWindow
from fareloom.operators.tables import qualified
from fareloom.plans import submit
from fareloom.session import INITIAL_PARTITIONS


def test_windows_are_read_as_days():
    args = submit.arguments(["--database", "d", "--batch-file", "f", "--batch-window", "2025-01-01:2025-01-31"])
    assert args.batch_window == DateWindow(date(2025, 1, 1), date(2025, 1, 31))
    assert args.stream_window == DateWindow(date(2025, 6, 1), date(2025, 7, 31))


def test_events_need_a_place_to_go():
    with pytest.raises(SystemExit):
        submit.arguments(["--database", "d", "--batch-file", "f", "--events", "e"])


def test_given_settings_stay_and_the_option_outranks_them(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    given = spark.conf.get(key)
    assert submit.session().conf.get(key) == given != str(INITIAL_PARTITIONS)
    try:
        args = submit.arguments(["--database", "d", "--batch-file", "f", "--shuffle-partitions", "77"])
        assert submit.session(args.shuffle_partitions).conf.get(key) == "77"
    finally:
        spark.conf.set(key, given)


def test_files_and_events_become_marts(spark, raw, event, config, tmp_path, capsys):
    raw({}).write.parquet(str(tmp_path / "april"))
    may = datetime(2025, 5, 2, 8)
    raw({"lpep_pickup_datetime": may, "lpep_dropoff_datetime": may.replace(hour=9)}).write.parquet(str(tmp_path / "may"))
    event({"event_id": "a"}, {"event_id": "b", "fare_amount": -1.0}).write.parquet(str(tmp_path / "events"))
    submit.main(
        ["--database", config.database]
        + ["--batch-file", str(tmp_path / "april"), "--batch-file", str(tmp_path / "may")]
        + ["--events", str(tmp_path / "events"), "--stream", str(tmp_path / "stream")]
        + ["--progress", str(tmp_path / "progress")]
    )
    assert capsys.readouterr().out.count("passed") == 8
    mart = spark.table(qualified(config.database, config.tables.daily_mart))
    assert sorted(r["pickup_date"] for r in mart.collect()) == [date(2025, 4, 10), date(2025, 5, 2), date(2025, 6, 10)]
