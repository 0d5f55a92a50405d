"""Business rules of a trip, in the accepting and in the refusing form."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from fareloom.config import TripRules
from fareloom.contracts import RAW_NAME
from fareloom.functions.scalars import above, at_least


def _named(raw: bool) -> dict[str, Column]:
    names = {name: RAW_NAME[name] if raw else name for name in RAW_NAME}
    return {name: F.col(actual) for name, actual in names.items()}


def valid_trip(rules: TripRules, raw: bool = True) -> Column:
    """True only for a trip that satisfies every rule; NULL counts as not satisfied."""
    c = _named(raw)
    return (
        (c["dropoff_datetime"] > c["pickup_datetime"])
        & c["pickup_location_id"].between(rules.lowest_zone, rules.highest_zone)
        & c["dropoff_location_id"].between(rules.lowest_zone, rules.highest_zone)
        & above(c["trip_distance"], 0)
        & at_least(c["fare_amount"], 0)
        & above(c["total_amount"], 0)
    )


def breakable_rules(rules: TripRules) -> dict[str, Column]:
    """Each rule by name, true for a trip that provably breaks it; unknown values break none."""
    c = _named(raw=False)
    zone = lambda name: ~c[name].between(rules.lowest_zone, rules.highest_zone)
    return {
        "dropoff after pickup": c["pickup_datetime"] >= c["dropoff_datetime"],
        "distance above zero": c["trip_distance"] <= 0,
        "fare not below zero": c["fare_amount"] < 0,
        "total above zero": c["total_amount"] <= 0,
        "pickup zone": zone("pickup_location_id"),
        "dropoff zone": zone("dropoff_location_id"),
        "source": ~F.col("source_type").isin(*rules.sources),
    }


def broken_trip(rules: TripRules) -> Column:
    """True for a trip that provably breaks a rule."""
    return reduce(or_, breakable_rules(rules).values())


def first_broken_rule(rules: TripRules) -> Column:
    """The name of the first rule that a trip provably breaks, else null."""
    return F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in breakable_rules(rules).items()))
