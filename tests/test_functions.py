"""Rounding, time differences, casts and digests."""

import math
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fareloom.config import DateWindow
from fareloom.functions.rounding import exact_totals, merged_totals, rounded_mean, rounded_minutes, rounded_sum
from fareloom.functions.scalars import above, fingerprint, in_window, month_of, seconds_between, stamp, whole_number


def one(spark, column, schema="x double", *row):
    return spark.createDataFrame([tuple(row)], schema).select(column.alias("r")).first()["r"]


def totals(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return df.agg(*exact_totals("x", F.col("x"))).select(
        rounded_sum("x").alias("sum"), rounded_mean("x").alias("mean")
    ).first()


def cents(value):
    return float(value.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


@pytest.mark.parametrize(
    "value, expected", [(1.5, 2), (2.5, 3), (-1.5, -2), (-2.5, -3), (1.4, 1), (0.0, 0), (None, None)]
)
def test_whole_number_rounds_half_away_from_zero(spark, value, expected):
    assert one(spark, whole_number(F.col("x")), "x double", value) == expected


def test_fingerprint_is_lower_case_sha256_of_the_joined_text(spark):
    import hashlib

    got = one(spark, fingerprint(F.col("a"), F.col("b")), "a int, b string", 7, "x")
    assert got == hashlib.sha256(b"7|x").hexdigest()


def test_fingerprint_of_an_unknown_part_is_unknown(spark):
    assert one(spark, fingerprint(F.col("a"), F.col("b")), "a int, b string", 7, None) is None


def test_fingerprint_keeps_parts_apart(spark):
    a = one(spark, fingerprint(F.col("a"), F.col("b")), "a string, b string", "1", "23")
    b = one(spark, fingerprint(F.col("a"), F.col("b")), "a string, b string", "12", "3")
    assert a != b


@pytest.mark.parametrize(
    "start, end, seconds",
    [
        (datetime(2025, 1, 1, 0, 0, 0, 900000), datetime(2025, 1, 1, 0, 0, 2, 100000), 1),
        (datetime(2025, 1, 1), datetime(2025, 1, 2), 86400),
        (datetime(2025, 1, 2), datetime(2025, 1, 1), -86400),
        (datetime(2025, 1, 1, 0, 0, 2, 100000), datetime(2025, 1, 1, 0, 0, 0, 900000), -1),
        (datetime(2025, 3, 30, 1), datetime(2025, 3, 30, 4), 10800),
        (None, datetime(2025, 1, 1), None),
    ],
)
def test_seconds_between(spark, start, end, seconds):
    got = one(spark, seconds_between(F.col("s"), F.col("e")), "s timestamp_ntz, e timestamp_ntz", start, end)
    assert got == seconds


def test_month_stays_a_date(spark):
    assert one(spark, month_of(F.col("d")), "d date", date(2025, 5, 31)) == date(2025, 5, 1)


def test_window_includes_both_ends(spark):
    window = DateWindow(date(2025, 4, 1), date(2025, 5, 31))
    days = [date(2025, 3, 31), date(2025, 4, 1), date(2025, 5, 31), date(2025, 6, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date").where(in_window(F.col("d"), window))
    assert sorted(r["d"] for r in df.collect()) == days[1:3]


def test_above_is_false_for_not_a_number(spark):
    assert one(spark, above(F.col("x"), 0), "x double", float("nan")) is False
    assert one(spark, above(F.col("x"), 0), "x double", float("inf")) is True


def test_stamp_is_zone_free_and_constant(spark):
    df = spark.range(3).select(stamp().alias("t"))
    assert df.schema["t"].dataType.simpleString() == "timestamp_ntz"
    assert df.distinct().count() == 1
    assert one(spark, stamp(datetime(2025, 8, 1, 12)), "x int", 1) == datetime(2025, 8, 1, 12)


def test_half_cents_round_away_from_zero(spark):
    assert totals(spark, [0.125, 0.0])["mean"] == 0.06
    assert totals(spark, [0.01, 0.0])["mean"] == 0.01
    assert totals(spark, [-0.01, 0.0])["mean"] == -0.01
    assert totals(spark, [1.005])["sum"] == 1.01


def test_nothing_to_add_gives_nothing(spark):
    assert tuple(totals(spark, [None, None])) == (None, None)


def test_unknown_values_do_not_count(spark):
    assert tuple(totals(spark, [1.0, None, 2.0])) == (3.0, 1.5)


def test_no_negative_zero(spark):
    assert math.copysign(1, totals(spark, [-0.001])["sum"]) == 1


def test_values_without_cents_follow_floating_point(spark):
    assert math.isnan(totals(spark, [1.0, float("nan")])["sum"])
    assert totals(spark, [1.0, float("inf")])["mean"] == float("inf")
    assert totals(spark, [1e300, 1e300])["sum"] == 2e300
    assert totals(spark, [5e18, 5e18])["sum"] == 1e19


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=50))
def test_sum_and_mean_are_exact(spark, millis):
    values = [m / 1000 for m in millis]
    got = totals(spark, values)
    exact = sum(Decimal(m) / 1000 for m in millis)
    assert got["sum"] == cents(exact)
    assert got["mean"] == cents(exact / len(values))


def test_partial_totals_add_up_to_the_same(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 1001 / 100).alias("x"))
    direct = df.agg(*exact_totals("x", F.col("x")))
    merged = df.groupBy("k").agg(*exact_totals("x", F.col("x"))).agg(*merged_totals("x"))
    shown = [rounded_sum("x").alias("s"), rounded_mean("x").alias("m")]
    assert direct.select(*shown).first() == merged.select(*shown).first()


def test_partitioning_does_not_change_the_result(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 100003 / 1000).alias("x"))
    shown = [rounded_sum("x").alias("s"), rounded_mean("x").alias("m")]
    results = {df.repartition(n).agg(*exact_totals("x", F.col("x"))).select(*shown).first() for n in (1, 3, 16)}
    assert len(results) == 1


@pytest.mark.parametrize("seconds, count, minutes", [(90, 1, 1.5), (1, 2, 0.01), (0, 3, 0.0), (-90, 1, -1.5)])
def test_minutes(spark, seconds, count, minutes):
    got = one(spark, rounded_minutes(F.col("s"), F.col("c")), "s bigint, c bigint", seconds, count)
    assert got == minutes


def both(df):
    return tuple(df.agg(*exact_totals("x", F.col("x"))).select(rounded_sum("x"), rounded_mean("x")).first())


def test_no_digit_is_cut(spark):
    thirds = spark.range(100_000).select((F.lit(1.0) / 3).alias("x"))
    assert both(thirds) == (33333.33, 0.33)
    tiny = spark.range(1000).select(F.lit(1e-5).alias("x"))
    assert both(tiny) == (0.01, 0.0)


def test_large_totals_do_not_depend_on_partitions(spark):
    values = [(9.1e15 + i * 3.0,) for i in range(50)] + [(0.1 * i,) for i in range(200)] + [(-7.3e12,)]
    df = spark.createDataFrame(values, "x double")
    assert len({both(df.repartition(n)) for n in (1, 3, 16)}) == 1
    assert both(df)[0] == round(math.fsum(v for v, in values), 2)
    assert both(spark.createDataFrame([(1e300,), (1.0,)], "x double")) == (1e300, 5e299)


def scaled(spark, value, rows, times):
    """Totals that stand for `rows * times` values: those of `rows` values, multiplied."""
    parts = spark.createDataFrame([(value,)] * rows, "x double").agg(*exact_totals("x", F.col("x")))
    return parts.select(*((F.col(c) * times).alias(c) for c in parts.columns))


@pytest.mark.parametrize("value", [0.3, 0.1, -0.3, 0.49999999, 1e-7])
def test_totals_of_forty_billion_values(spark, value):
    """Runs carry where totals meet, so that neither the number of values nor the order of merging shows."""
    part = scaled(spark, value, 100, 10**8)
    many = reduce(lambda a, b: a.unionAll(b), [part, part, part, part])
    mixed = many.unionAll(spark.createDataFrame([(0.005,)], "x double").agg(*exact_totals("x", F.col("x"))))
    shown = [rounded_sum("x").alias("s"), rounded_mean("x").alias("m"), F.col("x_rest").isNotNull().alias("exact")]
    orders = [mixed.repartition(1).agg(*merged_totals("x")), mixed.repartition(5).agg(*merged_totals("x"))]
    twice = mixed.withColumn("k", F.monotonically_increasing_id() % 2).groupBy("k").agg(*merged_totals("x")).agg(*merged_totals("x"))
    found = {tuple(df.select(*shown).first()) for df in (*orders, twice)}
    assert len(found) == 1
    total, mean, exact = found.pop()
    wanted = Decimal(value) * 4 * 10**10 + Decimal(0.005)
    assert exact and total == cents(wanted.quantize(Decimal("1e-9"))) and mean == cents(Decimal(value).quantize(Decimal("1e-9")))


def test_one_aggregate_adds_up_as_many_values_as_its_runs_have_room_for(spark):
    """The largest digits of every run, 2**42 times, fit the sums."""
    part = scaled(spark, 1 - 2**-53, 4, 2**40)
    row = part.select(rounded_sum("x").alias("s"), *part.columns).first()
    assert row.s == float(2**42)  # a two-thousandth less, in cents
    assert max(row[f"x_{run}"] for run in ("upper", "middle", "lower", "rest")) < 2**63
