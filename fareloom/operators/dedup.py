"""Keep the latest copy of each key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareloom.contracts import TIE_BREAK


def keep_latest(
    df: DataFrame,
    key: str = "trip_id",
    latest: str = "ingestion_time",
    tie_break: Iterable[str] = TIE_BREAK,
) -> DataFrame:
    """One row per key: the latest, ties settled by the given columns.

    Spark puts a group limit of one before the exchange, so each map task sends at most
    one row per key and a key that holds a large share of all rows stays small after it.
    """
    order = [F.col(latest).desc_nulls_last()] + [F.col(name).asc_nulls_last() for name in tie_break]
    ranked = df.withColumn("copy_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("copy_rank") == 1).drop("copy_rank")
