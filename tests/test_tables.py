"""Versioned tables, layout, and rebuilding single days."""

import glob
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fareloom.config import DateWindow
from fareloom.operators import gates, tables
from fareloom.operators.marts import daily_mart, daily_totals, monthly_mart
from fareloom.plans import taxi_warehouse
from fareloom.sources.files import read_files, stage_batch


def values(df, column="v"):
    return sorted(r[column] for r in df.select(column).collect())


def days(spark, rows):
    return spark.createDataFrame([(date(2025, 6, d), v) for d, v in rows], "d date, v int")


def test_names_are_quoted():
    assert tables.qualified("a", "b`c") == "`a`.`b``c`"
    assert tables.qualified("c", "d", "t") == "`c`.`d`.`t`"


def test_replacing_twice_leaves_the_same_rows(spark, config):
    df = days(spark, [(1, 1), (2, 2)])
    for _ in range(2):
        name = tables.replace_table(df, config.database, "t", "d")
    assert values(spark.table(name)) == [1, 2]
    assert len(tables.versions(spark, config.database, "t")) == 2


def test_a_table_can_be_replaced_by_a_query_on_itself(spark, config):
    name = tables.replace_table(days(spark, [(1, 1), (2, 2)]), config.database, "t", "d")
    tables.replace_table(spark.table(name).withColumn("v", F.col("v") * 10), config.database, "t", "d")
    assert values(spark.table(name)) == [10, 20]


def test_an_unpublished_version_is_not_visible(spark, config):
    name = tables.replace_table(days(spark, [(1, 1)]), config.database, "t", "d")
    tables.write_version(days(spark, [(1, 9)]), config.database, "t", tables.new_run_id(), "d")
    assert values(spark.table(name)) == [1]


def test_a_failing_write_leaves_the_published_rows(spark, config):
    name = tables.replace_table(days(spark, [(1, 1)]), config.database, "t", "d")
    broken = days(spark, [(1, 1)]).withColumn("v", F.raise_error("broken").cast("int"))
    with pytest.raises(Exception, match="broken"):
        tables.replace_table(broken, config.database, "t", "d")
    assert values(spark.table(name)) == [1]


def test_a_run_id_is_used_once(spark, config):
    tables.write_version(days(spark, [(1, 1)]), config.database, "t", "run")
    with pytest.raises(AnalysisException, match="TABLE_OR_VIEW_ALREADY_EXISTS"):
        tables.write_version(days(spark, [(1, 2)]), config.database, "t", "run")


def test_old_versions_go_but_never_the_published_one(spark, config):
    ids = ["r1", "r2", "r3", "r4"]
    for run_id, v in zip(ids, range(4)):
        tables.write_version(days(spark, [(1, v)]), config.database, "t", run_id)
    tables.publish(spark, config.database, "t", "r1")
    assert tables.published_version(spark, config.database, "t") == "r1"
    assert tables.drop_old_versions(spark, config.database, "t", keep=2) == ["r2"]
    assert tables.versions(spark, config.database, "t") == ["r1", "r3", "r4"]
    assert values(spark.table(tables.qualified(config.database, "t"))) == [0]


def test_a_day_filter_prunes_partitions(spark, config, capsys):
    name = tables.replace_table(days(spark, [(1, 1), (2, 2), (3, 3)]), config.database, "t", "d", ("v",))
    df = spark.table(name).where(F.col("d") == F.lit(date(2025, 6, 2)))
    capsys.readouterr()
    df.explain()
    text = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(d" in text and "InMemoryFileIndex(1 paths)" in text
    assert values(df) == [2]


def test_rows_are_sorted_within_a_file(spark, config):
    df = spark.range(500).select(F.lit(date(2025, 6, 1)).alias("d"), (F.col("id") * 7 % 500).cast("int").alias("v"))
    tables.write_version(df, config.database, "t", "run", "d", ("v",))
    for file in glob.glob(f"{config.location}/t__run/d=2025-06-01/*.parquet"):
        stored = [r["v"] for r in spark.read.parquet(file).collect()]
        assert stored == sorted(stored)


def test_a_hot_day_is_split_over_several_tasks(spark, config):
    """A third of all rows fall on one day; no single task may have to write them all."""
    first = date(2025, 6, 1)
    others = F.date_add(F.lit(first), (F.col("id") % 10 + 1).cast("int"))
    df = spark.range(0, 300_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit(first)).otherwise(others).alias("d"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
    )
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1m")
    try:
        name = tables.write_version(df, config.database, "t", "run", "d", ("v",))
    finally:
        spark.conf.set(setting, before)
    assert len(glob.glob(f"{config.location}/t__run/d=2025-06-01/*.parquet")) > 1
    assert spark.table(name).count() == 300_000


def test_versions_stay_bounded_and_failed_ones_go(spark, config):
    for _ in range(4):
        tables.replace_table(days(spark, [(1, 1)]), config.database, "t", "d")
    assert len(tables.versions(spark, config.database, "t")) == 2
    published = tables.published_version(spark, config.database, "t")
    tables.write_version(days(spark, [(1, 2)]), config.database, "t", "failed")
    for run_id in ("failed", published, "unknown"):
        tables.drop_unpublished(spark, config.database, ("t", "none"), run_id)
    assert "failed" not in tables.versions(spark, config.database, "t")
    assert tables.published_version(spark, config.database, "t") == published


def test_quotes_in_names_and_paths(spark, tmp_path):
    name, place = "odd_base", str(tmp_path / "it's here")
    tables.create_database(spark, name, place)
    table = tables.replace_table(days(spark, [(1, 1)]), name, "t", "d")
    assert values(spark.table(table)) == [1]
    spark.sql(f"DROP DATABASE {tables.qualified(name)} CASCADE")


def test_rebuilt_days_equal_a_full_build(spark, config, trip):
    def on(day, **more):
        pickup = datetime(2025, 6, day, 8)
        moved = {"pickup_datetime": pickup, "dropoff_datetime": pickup + timedelta(minutes=7)}
        return {**moved, "pickup_date": date(2025, 6, day), **more}

    names = config.tables
    old = trip(on(1), on(2, trip_id="a"), on(3, trip_id="b"))
    new = trip(on(1), on(2, trip_id="a"), on(2, trip_id="c", total_amount=1.0))
    published = spark.table(tables.replace_table(old, config.database, names.trips, "pickup_date"))
    accept = lambda _, report: gates.require(report)
    taxi_warehouse.publish_marts(spark, config, daily_totals(published), tables.new_run_id(), accept)
    window = DateWindow(date(2025, 6, 2), date(2025, 6, 30))
    marts = [tables.qualified(config.database, n) for n in (names.daily_mart, names.monthly_mart)]
    seen = lambda: [sorted(spark.table(m).collect(), key=str) for m in marts]
    before = seen()
    tables.replace_table(new, config.database, names.trips, "pickup_date")

    def crash(*_):
        raise RuntimeError("crash")

    for step in ("publish_together", "write_measured"):
        with pytest.MonkeyPatch.context() as patch, pytest.raises(RuntimeError, match="crash"):
            patch.setattr(taxi_warehouse, step, crash)
            taxi_warehouse.rebuild_days(spark, config, window)
        assert seen() == before
        assert len(tables.versions(spark, config.database, names.daily_mart)) == 1
    taxi_warehouse.rebuild_days(spark, config, window)
    wanted = [daily_mart(daily_totals(new)), monthly_mart(daily_totals(new))]
    assert seen() == [sorted(w.collect(), key=str) for w in wanted]


def test_a_rebuild_that_leaves_no_rows_fails_its_gate(spark, config, trip):
    names = config.tables
    tables.replace_table(trip({}), config.database, names.trips, "pickup_date")
    accept = lambda _, report: gates.require(report)
    taxi_warehouse.publish_marts(spark, config, daily_totals(trip({})), tables.new_run_id(), accept)
    tables.replace_table(trip({}).limit(0), config.database, names.trips, "pickup_date")
    with pytest.raises(gates.QualityGateError, match="check_mart_row_count"):
        taxi_warehouse.rebuild_days(spark, config, DateWindow(date(2025, 1, 1), date(2025, 12, 31)))
    assert spark.table(tables.qualified(config.database, names.daily_mart)).count() == 1


def test_a_day_filter_reaches_the_sorted_mart(spark, config, trip, capsys):
    accept = lambda _, report: gates.require(report)
    taxi_warehouse.publish_marts(spark, config, daily_totals(trip({})), "run", accept)
    assert not glob.glob(f"{config.location}/{config.tables.daily_mart}__run/*=*")
    capsys.readouterr()
    spark.table(tables.qualified(config.database, config.tables.daily_mart)).where("pickup_date = DATE '2025-06-10'").explain()
    assert "PushedFilters: [IsNotNull(pickup_date), EqualTo(pickup_date" in capsys.readouterr().out


def test_files_with_different_columns_load_together(spark, raw, tmp_path):
    raw({}).drop("tolls_amount").write.parquet(str(tmp_path / "one"))
    raw({"fare_amount": 5.0}).withColumn("extra", F.lit("x")).write.parquet(str(tmp_path / "two"))
    df = read_files(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert {"tolls_amount", "extra"} <= set(df.columns)
    assert {(r["fare_amount"], r["tolls_amount"], r["extra"]) for r in df.collect()} == {
        (12.0, None, None),
        (5.0, 0.0, "x"),
    }


def test_a_missing_file_is_an_error(spark, raw, tmp_path):
    raw({}).write.parquet(str(tmp_path / "one"))
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_files(spark, [str(tmp_path / "one"), str(tmp_path / "two")])


def test_staging_is_partitioned_by_pickup_day(spark, raw, config):
    rows = raw({}, {"lpep_pickup_datetime": datetime(2025, 5, 2, 1)}, {"lpep_pickup_datetime": None})
    name, _ = stage_batch(rows, config.database, "stage", "run")
    assert spark.table(name).count() == 3
    found = {f.split("lpep_pickup_date=")[1] for f in glob.glob(f"{config.location}/stage__run/lpep_*")}
    assert found == {"2025-04-10", "2025-05-02", "__HIVE_DEFAULT_PARTITION__"}


def test_differing_widths_load_together(spark, raw, tmp_path):
    narrow = raw({}).withColumn("passenger_count", F.lit(2).cast("short")).drop("tolls_amount")
    narrow.withColumn("fare_amount", F.lit(7.5).cast("float")).write.parquet(str(tmp_path / "one"))
    wide = raw({"PULocationID": 20}).withColumn("PULocationID", F.col("PULocationID").cast("bigint"))
    wide.write.parquet(str(tmp_path / "two"))
    df = read_files(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    kinds = dict(df.dtypes)
    assert (kinds["PULocationID"], kinds["passenger_count"], kinds["fare_amount"]) == ("bigint", "double", "double")
    assert sorted((r["PULocationID"], r["fare_amount"], r["passenger_count"]) for r in df.collect()) == [(10, 7.5, 2.0), (20, 12.0, 2.0)]


def shown(spark, config, names=("a", "b", "c")):
    return [values(spark.table(tables.qualified(config.database, n))) for n in names]


def test_several_tables_are_published_as_one(spark, config):
    """Whatever statement is the last to succeed, readers see all tables as before or all as after."""
    names = ("a", "b", "c")
    for n, run in enumerate(("r0", "r1")):
        for name in names:
            tables.write_version(days(spark, [(1, n)]), config.database, name, run)
    tables.publish_together(spark, config.database, dict.fromkeys(names, "r0"))
    assert shown(spark, config) == [[0], [0], [0]]
    define, seen = tables._define, []
    for allowed in range(20):
        done = 0

        def crashing(session, statement):
            nonlocal done
            if done == allowed:
                raise RuntimeError("crash")
            done += 1
            define(session, statement)

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(tables, "_define", crashing)
            try:
                tables.publish_together(spark, config.database, dict.fromkeys(names, "r1"))
                ended = True
            except RuntimeError:
                ended = False
        now = shown(spark, config)
        assert now in ([[0]] * 3, [[1]] * 3)
        version = {tables.published_version(spark, config.database, n) for n in names}
        assert version == {f"r{now[0][0]}"}
        seen.append(now[0][0])
        # A later run finds the same set, and what has not been published goes without harm.
        tables.drop_unpublished(spark, config.database, names, "r1")
        assert shown(spark, config) == now
        if ended:
            break
        for name in names:
            if now[0][0] == 0:
                tables.write_version(days(spark, [(1, 1)]), config.database, name, "r1")
        tables.publish_together(spark, config.database, dict.fromkeys(names, "r0"))
    # Three views with both versions, the release, three views with one version.
    assert ended and seen == [0] * 4 + [1] * 4


def test_a_pending_release_reads_one_version(spark, config, capsys):
    for run in ("r0", "r1"):
        tables.write_version(days(spark, [(1, 1)]), config.database, "a", run)
    tables.publish(spark, config.database, "a", "r0")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tables, "publish", lambda *_: None)
        tables.publish_together(spark, config.database, {"a": "r1"})
    capsys.readouterr()
    spark.table(tables.qualified(config.database, "a")).explain()
    plan = capsys.readouterr().out
    assert "a__r1" in plan and "a__r0" not in plan and "Union" not in plan


def test_a_first_release_that_fails_leaves_no_table(spark, config):
    tables.write_version(days(spark, [(1, 1)]), config.database, "a", "r0")
    with pytest.MonkeyPatch.context() as patch, pytest.raises(RuntimeError):
        release = tables._release
        patch.setattr(tables, "_release", lambda s, d, r: release(s, d, r) if r == "none" else (_ for _ in ()).throw(RuntimeError("crash")))
        tables.publish_together(spark, config.database, {"a": "r0"})
    tables.drop_unpublished(spark, config.database, ("a",), "r0")
    assert not spark.catalog.tableExists(tables.qualified(config.database, "a"))
    assert tables.versions(spark, config.database, "a") == []


def test_numbers_measured_while_writing(spark, config):
    """The same as the gates say afterwards, also for a table without rows and over several tasks."""
    checks = (gates.has_rows("rows"), gates.has_values("values", ["v"]))
    some = spark.range(1000).select(F.date_add(F.lit(date(2025, 6, 1)), (F.col("id") % 9).cast("int")).alias("d"), F.when(F.col("id") % 10 != 0, F.col("id")).alias("v"))
    for n, df in enumerate((some, some.where("v < 0"), some.where("v IS NOT NULL"))):
        name, measured = tables.write_measured(df, config.database, "t", f"r{n}", "d", ("v",), gates.measures(checks))
        afterwards = gates.evaluate(spark.table(name), *checks).collect()
        assert [tuple(r) for r in gates.judged(checks, measured)] == [tuple(r) for r in afterwards]
    assert measured == {"rows": 900, "values": 0}


def test_an_unknown_number_does_not_pass():
    assert [tuple(r) for r in gates.judged((gates.has_rows("rows"),), {})] == [("rows", None, False)]


def test_a_version_shares_the_folders_of_unchanged_days(spark, config):
    first, second, third = (tables.new_run_id() for _ in range(3))
    at = lambda run: tables.version_folder(spark, config.database, "t", run)
    tables.write_measured(days(spark, [(1, 1), (2, 2), (3, 3)]), config.database, "t", first, "d", location=at(first))
    # The second day gets other rows, the third day loses its only one.
    tables.write_days(days(spark, [(2, 20), (2, 21)]), config.database, "t", second, first, [date(2025, 6, 2), date(2025, 6, 3)], "d")
    name = tables.version_name(config.database, "t", second)
    assert values(spark.table(name)) == [1, 20, 21]
    folders = tables.day_folders(spark.table(name))
    assert {day: first in folder for day, folder in folders.items()} == {"d=2025-06-01": True, "d=2025-06-02": False}
    tables.write_days(days(spark, [(4, 4)]), config.database, "t", third, second, [date(2025, 6, 4)], "d")
    tables.publish(spark, config.database, "t", third)
    assert tables.drop_old_versions(spark, config.database, "t", keep=1) == [first, second]
    assert values(spark.table(tables.qualified(config.database, "t"))) == [1, 4, 20, 21]
    # Of the first version only the day that is still in use is left.
    assert sorted(f.rsplit("/", 1)[1] for f in glob.glob(f"{config.location}/t__{first}/*")) == ["d=2025-06-01"]
    assert sorted(f.rsplit("/", 1)[1] for f in glob.glob(f"{config.location}/t__{second}/*")) == ["d=2025-06-02"]
    tables.replace_table(days(spark, [(9, 9)]), config.database, "t", "d", keep=1)
    assert glob.glob(f"{config.location}/t__{first}") == glob.glob(f"{config.location}/t__{second}") == []


def test_a_failed_version_by_days_takes_nothing_of_its_base(spark, config):
    first, second = tables.new_run_id(), tables.new_run_id()
    tables.write_measured(days(spark, [(1, 1), (2, 2)]), config.database, "t", first, "d", location=tables.version_folder(spark, config.database, "t", first))
    tables.publish(spark, config.database, "t", first)
    tables.write_days(days(spark, [(2, 20)]), config.database, "t", second, first, [date(2025, 6, 2)], "d")
    tables.drop_unpublished(spark, config.database, ("t",), second)
    assert values(spark.table(tables.qualified(config.database, "t"))) == [1, 2]
    assert not glob.glob(f"{config.location}/t__{second}")
