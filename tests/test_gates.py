"""Every gate in both directions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import RAW_ROW, TRIP_ROW
from fareloom.config import DateWindow, TripRules
from fareloom.operators import gates
from fareloom.operators.column_tests import (
    DAILY_SUMMARY_TESTS,
    STAGED_TRIP_TESTS,
    ColumnTests,
    relationship_failures,
    run_column_tests,
)
from fareloom.operators.marts import zone_summary
from fareloom.operators.tables import new_run_id, write_version
from fareloom.sources.inline import example_trips

RULES = TripRules()
WINDOW = DateWindow(date(2025, 6, 1), date(2025, 7, 31))


def passed(df, gate):
    return gates.evaluate(df, gate).first()["passed"]


def test_row_count(raw):
    assert passed(raw({}), gates.has_rows("g"))
    assert not passed(raw({}).where("false"), gates.has_rows("g"))


@pytest.mark.parametrize(
    "column", ["lpep_pickup_datetime", "lpep_dropoff_datetime", "PULocationID", "DOLocationID"]
)
def test_required_values(raw, column):
    assert passed(raw({}), gates.has_values("g"))
    assert not passed(raw({}, {column: None}), gates.has_values("g"))


def test_other_columns_may_be_unknown(raw):
    assert passed(raw({"passenger_count": None, "payment_type": None}), gates.has_values("g"))


def test_required_values_hold_for_no_rows(raw):
    assert passed(raw({}).where("false"), gates.has_values("g"))


def test_schema(spark, trip, config):
    good = write_version(trip({}).withColumn("extra", F.lit(1)), config.database, "good", new_run_id())
    bad = write_version(trip({}).drop("payment_type"), config.database, "bad", new_run_id())
    retyped = trip({}).withColumn("payment_type", F.lit("card")).select(*reversed(trip({}).columns))
    retyped = write_version(retyped, config.database, "retyped", new_run_id())
    assert gates.evaluate_columns(spark, "g", good).first()["passed"]
    assert gates.evaluate_columns(spark, "g", retyped).first()["passed"]
    row = gates.evaluate_columns(spark, "g", bad).first()
    assert (row["observed"], row["passed"]) == (14, False)


@pytest.mark.parametrize(
    "change",
    [
        {"dropoff_datetime": TRIP_ROW["pickup_datetime"]},
        {"trip_distance": 0.0},
        {"fare_amount": -0.01},
        {"total_amount": 0.0},
        {"pickup_location_id": 0},
        {"pickup_location_id": 266},
        {"dropoff_location_id": 0},
        {"dropoff_location_id": 266},
        {"source_type": "other"},
    ],
)
def test_values(trip, change):
    assert passed(trip({}), gates.has_valid_values("g", RULES))
    row = gates.evaluate(trip({}, change), gates.has_valid_values("g", RULES)).first()
    assert (row["observed"], row["passed"]) == (1, False)


@pytest.mark.parametrize("column", ["trip_distance", "dropoff_datetime", "pickup_location_id", "source_type"])
def test_unknown_values_break_no_rule(trip, column):
    assert passed(trip({column: None}), gates.has_valid_values("g", RULES))


def test_a_broken_rule_counts_next_to_an_unknown_value(trip):
    assert not passed(trip({"trip_distance": None, "fare_amount": -1.0}), gates.has_valid_values("g", RULES))


def test_unique_key(trip):
    assert passed(trip({}, {"trip_id": "t2"}), gates.has_unique_key("g"))
    assert not passed(trip({}, {}), gates.has_unique_key("g"))
    assert not passed(trip({}, {"trip_id": None}), gates.has_unique_key("g"))
    assert not passed(trip({"trip_id": None}, {"trip_id": None}), gates.has_unique_key("g"))


def test_stream_rows(event):
    def found(*changes):
        return passed(gates.stream_rows(event(*changes), WINDOW), gates.has_rows("g"))

    assert found({"pickup_date": date(2025, 7, 31)})
    assert not found({"pickup_date": date(2025, 5, 31)}, {"pickup_date": date(2025, 8, 1)})
    assert not found({"source_type": "batch"})
    assert not found({"source_type": None})


def test_gates_of_a_table_share_one_scan(spark, raw, tmp_path, capsys):
    path = str(tmp_path / "raw")
    raw({}, {"PULocationID": None}).write.parquet(path)
    report = gates.evaluate(spark.read.parquet(path), gates.has_rows("rows"), gates.has_values("values"))
    capsys.readouterr()
    report.explain()
    assert capsys.readouterr().out.count("FileScan") == 1
    assert {r["gate"]: (r["observed"], r["passed"]) for r in report.collect()} == {
        "rows": (2, True),
        "values": (1, False),
    }


def test_require_names_every_failed_gate(raw):
    report = gates.evaluate(raw({}).where("false"), gates.has_rows("a"), gates.has_values("b"), gates.has_rows("c"))
    with pytest.raises(gates.QualityGateError, match="a, c$"):
        gates.require(report)
    assert [r["gate"] for r in gates.require(gates.evaluate(raw({}), gates.has_rows("a")))] == ["a"]


def test_assertions_stop_at_the_first_that_fails(spark):
    assertions = gates.summary_assertions()
    good = spark.createDataFrame([(1, 2.0)], "trip_count bigint, total_revenue double")
    gates.assert_all(good, assertions)
    with pytest.raises(gates.QualityGateError, match="^no rows in daily_trip_summary$"):
        gates.assert_all(good.where("false"), assertions)
    for bad in [(0, 1.0), (1, -0.01)]:
        with pytest.raises(gates.QualityGateError, match="^a summary row without trips or with negative revenue$"):
            gates.assert_all(good.union(spark.createDataFrame([bad], good.schema)), assertions)


def test_declared_tests_of_the_example_pass(spark):
    trips = example_trips(spark)
    assert all(r["passed"] for r in run_column_tests(trips, STAGED_TRIP_TESTS).collect())
    assert all(r["passed"] for r in run_column_tests(zone_summary(trips), DAILY_SUMMARY_TESTS).collect())


def test_column_tests_count_failures(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), (None, 3), (None, 3)], "k string, v int")
    report = run_column_tests(df, [ColumnTests("k", not_null=True, unique=True), ColumnTests("v", not_null=True)])
    got = {(r["test"], r["column"]): (r["failures"], r["passed"]) for r in report.collect()}
    assert got == {
        ("not_null", "k"): (2, False),
        ("unique", "k"): (1, False),
        ("not_null", "v"): (1, False),
    }


def test_unique_ignores_unknown_values(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "k string")
    assert run_column_tests(df, [ColumnTests("k", unique=True)]).first()["passed"]


def test_relationships(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    got = relationship_failures(child, "k", parent, "id").collect()
    assert [(r["missing_key"], r["child_rows"]) for r in got] == [(3, 2)]
    assert relationship_failures(child.where("k < 3"), "k", parent, "id").count() == 0
