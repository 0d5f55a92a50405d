"""The trip warehouse from files and stream to published marts.

Each table is written, checked and only then published, so a failing gate
leaves every published table as the last good run left it. Trips and what is made of them are published as one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fareloom.config import DateWindow, WarehouseConfig
from fareloom.contracts import BATCH_DAY, TRIP_CLUSTER
from fareloom.functions.scalars import in_window
from fareloom.operators import gates
from fareloom.operators.conform import unified_trips
from fareloom.operators.dedup import keep_latest
from fareloom.operators.marts import daily_mart, daily_totals, monthly_mart
from fareloom.operators.tables import (
    create_database,
    drop_old_versions,
    drop_unpublished,
    literal,
    new_run_id,
    properties,
    publish,
    publish_together,
    published_version,
    qualified,
    version_folder,
    version_name,
    versions,
    write_days,
    write_measured,
    write_version,
)
from fareloom.session import scratch_path
from fareloom.sources.files import file_states, read_files, stage_batch


@dataclass(frozen=True)
class GateResult:
    table: str
    gate: str
    observed: int
    passed: bool


def trips(
    raw: DataFrame, staged_stream: DataFrame, config: WarehouseConfig, run_stamp: datetime | None = None
) -> DataFrame:
    """The latest copy of every valid trip of both sources."""
    return keep_latest(unified_trips(raw, staged_stream, config, run_stamp))


Passed = Callable[..., None]


def run(
    spark: SparkSession,
    config: WarehouseConfig,
    batch_files: Sequence[str],
    run_stamp: datetime | None = None,
) -> list[GateResult]:
    """Load, check, transform, check, summarise, check; publish what passed.

    The stream staging table has to exist under its configured name. Raises
    `QualityGateError` at the first table whose gates do not all pass. Gates that count rows are measured while
    their table is written. A call after one that failed goes on from the tables that had passed all their gates, if files, stream,
    settings and stamp are the same (`Progress`).
    """
    names, database = config.tables, config.database
    results: list[GateResult] = []

    def passed(table: str, *reports: DataFrame | Sequence[Row]) -> None:
        results.extend(GateResult(table, r["gate"], r["observed"], r["passed"]) for r in gates.require(*reports))

    create_database(spark, database, config.location)
    run_id = new_run_id()
    stored = (names.batch_staging, names.trips, names.daily_totals, names.daily_mart, names.monthly_mart)
    progress = Progress.of(spark, config, batch_files, run_stamp)
    try:
        # An empty stream costs one scan, not a transform.
        stream = spark.table(qualified(database, names.stream_staging))
        seen = gates.stream_rows(stream, config.stream_window)
        passed(names.stream_staging, gates.evaluate(seen, gates.has_rows("check_stream_data_exists")))

        if names.batch_staging not in progress.done:
            arrived = (gates.has_rows("check_batch_row_count"), gates.has_values("check_batch_required_nulls"))
            _, measured = stage_batch(read_files(spark, batch_files), database, names.batch_staging, run_id, gates.measures(arrived))
            rows = gates.judged(arrived, measured)
            passed(names.batch_staging, rows)
            publish(spark, database, names.batch_staging, run_id)
            progress.add(names.batch_staging, run_id, rows)
        else:
            passed(names.batch_staging, progress.reports[names.batch_staging])

        if names.trips not in progress.done:
            batch = version_name(database, names.batch_staging, progress.done[names.batch_staging])
            latest = trips(spark.table(batch), stream, config, run_stamp)
            valid = (gates.has_valid_values("check_invalid_values", config.rules),)
            folder = version_folder(spark, database, names.trips, run_id)
            table, measured = write_measured(latest, database, names.trips, run_id, "pickup_date", TRIP_CLUSTER, gates.measures(valid), folder)
            before = len(results)
            _check_trips(spark, config, table, gates.judged(valid, measured), passed)
            progress.add(names.trips, run_id, [Row(gate=r.gate, observed=r.observed, passed=r.passed) for r in results[before:]])
        else:
            passed(names.trips, progress.reports[names.trips])

        current = spark.table(version_name(database, names.trips, progress.done[names.trips]))
        marts = store_marts(spark, config, daily_totals(current), run_id, passed)
        publish_together(spark, database, {names.trips: progress.done[names.trips], **marts})
    except BaseException:
        drop_unpublished(spark, database, [t for t in stored if progress.done.get(t) != run_id], run_id)
        raise
    progress.clear()
    for table in stored:
        drop_old_versions(spark, database, table, config.kept_versions)
    return results


class Progress:
    """The run log: tables of a run that have passed their gates, with their versions and reports, and what the run was made from.

    It is kept as the properties of a small view, so that each step is noted by one statement of the catalog.
    """

    def __init__(self, spark: SparkSession, config: WarehouseConfig, inputs: str):
        self.spark, self.config, self.inputs = spark, config, inputs
        self.done: dict[str, str] = {}
        self.reports: dict[str, list[Row]] = {}

    @classmethod
    def of(cls, spark: SparkSession, config: WarehouseConfig, batch_files: Sequence[str], run_stamp: datetime | None) -> Progress:
        """What an earlier call with the same inputs has finished; tables that one with other inputs has left are dropped."""
        names, database = config.tables, config.database
        stream = sorted(spark.table(qualified(database, names.stream_staging)).inputFiles())
        told = repr((config, run_stamp, file_states(spark, batch_files), stream))
        log = cls(spark, config, sha256(told.encode()).hexdigest())
        kept = properties(spark, database, names.run_log)
        steps = json.loads(kept.get("steps", "[]"))
        if kept.get("inputs") == log.inputs and all(run_id in versions(spark, database, table) for table, run_id, _ in steps):
            for table, run_id, rows in steps:
                log.done[table], log.reports[table] = run_id, [Row(**row) for row in rows]
        else:
            for table, run_id, _ in steps:
                drop_unpublished(spark, database, [table], run_id)
        return log

    def add(self, table: str, run_id: str, rows: Sequence[Row]) -> None:
        self.done[table], self.reports[table] = run_id, list(rows)
        steps = json.dumps([[t, r, [row.asDict() for row in self.reports[t]]] for t, r in self.done.items()])
        named = f"TBLPROPERTIES ('inputs' = '{self.inputs}', 'steps' = {literal(steps)})"
        self.spark.sql(f"CREATE OR REPLACE VIEW {qualified(self.config.database, self.config.tables.run_log)} {named} AS SELECT {literal(self.inputs)} AS inputs")

    def clear(self) -> None:
        self.spark.sql(f"DROP VIEW IF EXISTS {qualified(self.config.database, self.config.tables.run_log)}")


def _check_trips(spark: SparkSession, config: WarehouseConfig, table: str, measured: Sequence[Row], passed: Passed, checked: Column | None = None) -> None:
    """The gates of a version of the trips, that on its keys over the rows that are `checked`."""
    rows = spark.table(table) if checked is None else spark.table(table).where(checked)
    passed(
        config.tables.trips,
        gates.evaluate_columns(spark, "check_required_schema", table),
        measured,
        gates.evaluate(rows, gates.has_unique_key("check_duplicates")),
    )


def store_marts(spark: SparkSession, config: WarehouseConfig, totals: DataFrame, run_id: str, passed: Passed) -> dict[str, str]:
    """Store totals and both marts and check both marts; the tables and their run, to be published.

    A mart has a few rows a day, so it is stored as few files sorted by day, whose row-group statistics serve
    day filters, and not as a folder per day.
    """
    names, database = config.tables, config.database
    stored = spark.table(write_version(totals, database, names.daily_totals, run_id, None, ("pickup_date",)))
    some = (gates.has_rows("check_mart_row_count"),)
    for name, rows, day in ((names.daily_mart, daily_mart(stored), "pickup_date"), (names.monthly_mart, monthly_mart(stored), "pickup_month")):
        _, measured = write_measured(rows, database, name, run_id, None, (day, "source_type"), gates.measures(some))
        passed(name, gates.judged(some, measured))
    return dict.fromkeys((names.daily_totals, names.daily_mart, names.monthly_mart), run_id)


def publish_marts(spark: SparkSession, config: WarehouseConfig, totals: DataFrame, run_id: str, passed: Passed) -> None:
    """Store totals and both marts, check both marts, and publish all three as one."""
    publish_together(spark, config.database, store_marts(spark, config, totals, run_id, passed))


def _accept(_: str, *reports: DataFrame | Sequence[Row]) -> None:
    gates.require(*reports)


def _totals_with(spark: SparkSession, config: WarehouseConfig, trips_table: DataFrame, inside: Column) -> DataFrame:
    """The stored totals, with those of some days made anew from the trips; only these days of the trips are read."""
    others = spark.table(qualified(config.database, config.tables.daily_totals)).where(~F.coalesce(inside, F.lit(False)))
    return others.unionByName(daily_totals(trips_table.where(inside)))


def rebuild_days(spark: SparkSession, config: WarehouseConfig, window: DateWindow) -> None:
    """Bring both marts up to date with the published trips of the days of a window.

    Only these days of the trips are read. Their totals join the stored totals of all other days in a new
    version, from which both marts are made, checked and then published; until then, and
    after a failure, readers see the marts as they were.
    """
    names, database, run_id = config.tables, config.database, new_run_id()
    stored = (names.daily_totals, names.daily_mart, names.monthly_mart)
    try:
        totals = _totals_with(spark, config, spark.table(qualified(database, names.trips)), in_window(F.col("pickup_date"), window))
        publish_marts(spark, config, totals, run_id, _accept)
    except BaseException:
        drop_unpublished(spark, database, stored, run_id)
        raise
    for table in stored:
        drop_old_versions(spark, database, table, config.kept_versions)


def _on_days(column: str, days: Iterable[date]) -> Column:
    return F.col(column).isin([F.lit(day) for day in days])


def _kept(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared scratch folder and read again, so that several steps use the same rows."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _days_of(rows: DataFrame) -> list[date]:
    """The days of some trips: a number of values that calendars bound."""
    return sorted(r["pickup_date"] for r in rows.select("pickup_date").distinct().collect())


def _copies(spark: SparkSession, config: WarehouseConfig, batch: Callable[[str], Column], run_stamp: datetime | None) -> DataFrame:
    """Valid staged rows of both sources on some days, `batch` being the condition on a day column; it prunes both tables."""
    names, database = config.tables, config.database
    raw = spark.table(qualified(database, names.batch_staging)).where(batch(BATCH_DAY))
    stream = spark.table(qualified(database, names.stream_staging)).where(batch("pickup_date"))
    return unified_trips(raw, stream, config, run_stamp)


def trip_days(spark: SparkSession, config: WarehouseConfig) -> str:
    """The key-to-day table of the staged rows: trip_id and pickup_date, each pair once, in buckets by trip_id.

    It is made with the first rebuild after a run, by one pass over what is staged, and rebuilds add to it what has come since. A
    pair that is no longer staged does no harm: it is looked for and not found.
    """
    names, database = config.tables, config.database
    staged = published_version(spark, database, names.batch_staging)
    if staged not in versions(spark, database, names.trip_days):
        pairs = _copies(spark, config, lambda _: F.lit(True), None).select("trip_id", "pickup_date")
        # Files know how many rows they have.
        rows = sum(spark.table(table).count() for table in (version_name(database, names.batch_staging, staged), qualified(database, names.stream_staging)))
        _add_pairs(pairs, max(config.key_buckets, -(-rows // config.rows_per_bucket)), version_name(database, names.trip_days, staged))
        for old in versions(spark, database, names.trip_days):
            if old != staged:
                spark.sql(f"DROP TABLE {version_name(database, names.trip_days, old)}")
    return version_name(database, names.trip_days, staged)


def _add_pairs(pairs: DataFrame, buckets: int, name: str) -> None:
    # One file a bucket. Equal pairs meet by their key already, so they are made one without a second shuffle.
    dealt = pairs.repartition(buckets, "trip_id").distinct()
    dealt.write.format("parquet").mode("append").bucketBy(buckets, "trip_id").sortBy("trip_id").saveAsTable(name)


def _buckets(spark: SparkSession, name: str) -> int:
    """How many buckets a table has."""
    told = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()
    return int(told["data_type"])


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that one of two tables has more often than the other, each once, by one shuffle of both."""
    signed = a.withColumn("surplus", F.lit(1)).unionByName(b.withColumn("surplus", F.lit(-1)))
    return signed.groupBy(*a.columns).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0").drop("surplus")


def rebuild_trips(spark: SparkSession, config: WarehouseConfig, window: DateWindow, run_stamp: datetime | None = None) -> list[date]:
    """Bring trips and marts up to date with what is staged for the days of a window; the days that changed.

    Staged rows and published trips of the window are read, and of all other days only those that hold a copy of
    a trip that the window touches, found in the key-to-day table. The latest copies of the touched
    trips are compared with the published ones; only days on which they differ are written, in a version that shares all
    other day folders with the one before. Trips and marts of these days are checked and published as one. The rows of batch trips have the
    ingestion time `run_stamp`, as in `run`.
    """
    names, database, run_id = config.tables, config.database, new_run_id()
    base = published_version(spark, database, names.trips)
    current = spark.table(version_name(database, names.trips, base))
    inside = lambda day: in_window(F.col(day), window)
    keys = trip_days(spark, config)

    here = _kept(_copies(spark, config, inside, run_stamp), "window-copies")
    touched = here.select("trip_id").unionByName(current.where(inside("pickup_date")).select("trip_id")).distinct()
    touched = _kept(touched, "touched-trips")
    known = spark.table(keys).join(touched, "trip_id", "left_semi")
    elsewhere = _kept(known.where(~inside("pickup_date")), "other-days")
    fresh = here.select("trip_id", "pickup_date").distinct().join(known, ["trip_id", "pickup_date"], "left_anti")
    _add_pairs(_kept(fresh, "new-pairs"), _buckets(spark, keys), keys)

    other_days = _days_of(elsewhere)
    there = _copies(spark, config, lambda day: _on_days(day, other_days), run_stamp).join(touched, "trip_id", "left_semi")
    latest = _kept(keep_latest(here.unionByName(there)), "latest-copies")
    before = current.where(inside("pickup_date") | _on_days("pickup_date", other_days))
    published = _kept(before.join(touched, "trip_id", "left_semi").select(latest.columns), "published-copies")
    days = _days_of(_differing(latest, published))
    if not days:
        return []

    changed = _on_days("pickup_date", days)
    rows = current.where(changed).join(touched, "trip_id", "left_anti").select(latest.columns).unionByName(latest.where(changed))
    stored = (names.trips, names.daily_totals, names.daily_mart, names.monthly_mart)
    valid = (gates.has_valid_values("check_invalid_values", config.rules),)
    try:
        table, measured = write_days(rows, database, names.trips, run_id, base, days, "pickup_date", TRIP_CLUSTER, gates.measures(valid))
        _check_trips(spark, config, table, gates.judged(valid, measured), _accept, changed)
        marts = store_marts(spark, config, _totals_with(spark, config, spark.table(table), changed), run_id, _accept)
        publish_together(spark, database, {names.trips: run_id, **marts})
    except BaseException:
        drop_unpublished(spark, database, stored, run_id)
        raise
    for table in stored:
        drop_old_versions(spark, database, table, config.kept_versions)
    return days
