"""Scalar helpers whose default in Spark differs from what the warehouse needs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from fareloom.config import DateWindow


def whole_number(value: Column) -> Column:
    """Nearest integer, halves away from zero; a plain cast would cut the fraction off."""
    return F.round(value).cast("bigint")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a bar, as lower-case hex; NULL if any part is NULL."""
    pieces = []
    for part in parts:
        pieces += [F.lit("|"), part.cast("string")]
    return F.sha2(F.concat(*pieces[1:]), 256)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, a started second not counted."""
    return F.call_function("div", end - start, F.expr("INTERVAL '1' SECOND"))


def month_of(day: Column) -> Column:
    """First day of the month, still a date."""
    return F.trunc(day, "MM")


def in_window(day: Column, window: DateWindow) -> Column:
    return day.between(F.lit(window.first), F.lit(window.last))


def above(value: Column, limit: float) -> Column:
    """value > limit, false for not-a-number, which Spark ranks above everything."""
    return (value > limit) & ~F.isnan(value)


def at_least(value: Column, limit: float) -> Column:
    return (value >= limit) & ~F.isnan(value)


def stamp(moment: datetime | None = None) -> Column:
    """One zone-free timestamp for all rows of a run; now, in UTC, if none is given."""
    moment = moment or datetime.now(timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(" ")).cast("timestamp_ntz")
