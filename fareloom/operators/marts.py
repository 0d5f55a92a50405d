"""Daily, monthly and zone summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.functions.rounding import exact_totals, merged_totals, rounded_mean, rounded_minutes, rounded_sum
from fareloom.functions.scalars import month_of, seconds_between


def daily_totals(trips: DataFrame) -> DataFrame:
    """Unrounded totals per day and source, the one pass over the trips that both marts need."""
    seconds = seconds_between(F.col("pickup_datetime"), F.col("dropoff_datetime"))
    return trips.groupBy("pickup_date", "source_type").agg(
        F.count(F.lit(1)).alias("trip_count"),
        *exact_totals("total", F.col("total_amount")),
        *exact_totals("distance", F.col("trip_distance")),
        F.sum(seconds).alias("seconds"),
        F.count(seconds).alias("seconds_count"),
    )


def _money_and_distance() -> list:
    return [
        rounded_sum("total").alias("total_revenue"),
        rounded_mean("total").alias("average_total_amount"),
        rounded_mean("distance").alias("average_trip_distance"),
    ]


def daily_mart(totals: DataFrame) -> DataFrame:
    return totals.select(
        "pickup_date",
        "source_type",
        "trip_count",
        *_money_and_distance(),
        rounded_minutes(F.col("seconds"), F.col("seconds_count")).alias("average_duration_minutes"),
    )


def monthly_mart(totals: DataFrame) -> DataFrame:
    """Adds up daily totals, which are exact, so no second pass over the trips is needed."""
    return (
        totals.groupBy(month_of(F.col("pickup_date")).alias("pickup_month"), "source_type")
        .agg(F.sum("trip_count").alias("trip_count"), *merged_totals("total"), *merged_totals("distance"))
        .select("pickup_month", "source_type", "trip_count", *_money_and_distance())
    )


def zone_summary(trips: DataFrame) -> DataFrame:
    """Trips and revenue per day and pickup zone."""
    return (
        trips.groupBy("trip_date", "pickup_zone_id")
        .agg(F.count(F.lit(1)).alias("trip_count"), *exact_totals("total", F.col("total_amount")))
        .select("trip_date", "pickup_zone_id", "trip_count", rounded_sum("total").alias("total_revenue"))
    )
