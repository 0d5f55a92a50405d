"""Catalog tables: versioned replacement, releases of several tables, day partitions, clustering.

A Parquet table cannot be replaced in one step in the session catalog, so each run
writes a table of its own and the public name is a view that is moved to it once the
gates have passed. Readers see the old rows or the new rows, never a mixture,
and a run that dies leaves the published table as it was.

Several tables are published by one statement. Each view is first given both versions, and shows the new one if
`RELEASE_VIEW` names the release it belongs to; the definition of that small view is the step that moves them all. Then the
views go back to one version each. The choice is a constant to the optimizer, which leaves one scan in the plan.

A version of a table by days can share the folders of days that did not change with the version it is based on; a folder
goes when no version uses it any more.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from datetime import date, datetime, timezone
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession

VERSION_PROPERTY = "published_version"
PENDING_VERSION, PENDING_RELEASE = "pending_version", "pending_release"
RELEASE_VIEW, RELEASE_PROPERTY = "published_release", "release"
# Partitions that one statement adds, at most.
ADDED_AT_ONCE = 500


def qualified(*parts: str) -> str:
    """A full table name, `database, table` or `catalog, database, table`, each part in backticks."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def literal(text: str) -> str:
    """A string in SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def new_run_id() -> str:
    return f"{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}_{uuid4().hex[:8]}"


# What `new_run_id` makes.
_RUN_ID = re.compile(r"\d{20}_[0-9a-f]{8}")


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    at = f" LOCATION {literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {qualified(database)}{at}")


def clustered(df: DataFrame, partition_by: str | None, cluster_by: Sequence[str] = ()) -> DataFrame:
    """Bring the rows of a partition together and sort them for tight row-group statistics.

    The rebalance hint lets adaptive execution cut a partition that is too large for one
    task into several and put small ones together, so a day with a third of all rows becomes
    several files, not one slow task.
    """
    moved = df.hint("rebalance", partition_by) if partition_by else df.hint("rebalance")
    order = ([partition_by] if partition_by else []) + list(cluster_by)
    return moved.sortWithinPartitions(*order) if order else moved


def version_name(database: str, table: str, run_id: str) -> str:
    return qualified(database, f"{table}__{run_id}")


def write_version(
    df: DataFrame,
    database: str,
    table: str,
    run_id: str,
    partition_by: str | None = None,
    cluster_by: Sequence[str] = (),
) -> str:
    """Write the rows of one run to a new table and return its qualified name."""
    return write_measured(df, database, table, run_id, partition_by, cluster_by)[0]


def write_measured(
    df: DataFrame,
    database: str,
    table: str,
    run_id: str,
    partition_by: str | None = None,
    cluster_by: Sequence[str] = (),
    measures: Sequence[Column] = (),
    location: str | None = None,
) -> tuple[str, dict[str, int]]:
    """`write_version`, and aggregates over the rows it has written, measured on their way.

    They are observed after the last shuffle, in the tasks that write: a task that is run again counts once, as only the
    one that is committed reports. With a `location` the folder stays when the table is dropped.
    """
    name = version_name(database, table, run_id)
    laid, seen = clustered(df, partition_by, cluster_by), Observation()
    writer = (laid.observe(seen, *measures) if measures else laid).write.format("parquet").mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(name)
    return name, seen.get if measures else {}


def _define(spark: SparkSession, statement: str) -> None:
    """One change of the catalog."""
    spark.sql(statement)


def publish(spark: SparkSession, database: str, table: str, run_id: str) -> str:
    """Point the public name at the rows of a run."""
    public, source = qualified(database, table), version_name(database, table, run_id)
    _define(spark, f"CREATE OR REPLACE VIEW {public} TBLPROPERTIES ('{VERSION_PROPERTY}' = '{run_id}') AS SELECT * FROM {source}")
    return public


def publish_together(spark: SparkSession, database: str, runs: Mapping[str, str]) -> None:
    """Point several public names at the rows of a run each, in one step.

    Whatever statement is the last one to succeed, readers see all tables as before or all as after.
    """
    release, view = new_run_id(), qualified(database, RELEASE_VIEW)
    if released(spark, database) is None:
        _release(spark, database, "none")
    chosen = f"(SELECT {RELEASE_PROPERTY} FROM {view})"
    for table, run_id in runs.items():
        public, new = qualified(database, table), version_name(database, table, run_id)
        columns = spark.table(new).columns
        rows = f"SELECT {', '.join(map(qualified, columns))} FROM {new} WHERE {chosen} = '{release}'"
        current = published_version(spark, database, table)
        if current:
            old = version_name(database, table, current)
            known = set(spark.table(old).columns)
            listed = ", ".join(qualified(c) if c in known else f"NULL AS {qualified(c)}" for c in columns)
            rows += f" UNION ALL SELECT {listed} FROM {old} WHERE {chosen} <> '{release}'"
        told = {VERSION_PROPERTY: current or "", PENDING_VERSION: run_id, PENDING_RELEASE: release}
        listed = ", ".join(f"'{k}' = '{v}'" for k, v in told.items())
        _define(spark, f"CREATE OR REPLACE VIEW {public} TBLPROPERTIES ({listed}) AS {rows}")
    _release(spark, database, release)
    for table, run_id in runs.items():
        publish(spark, database, table, run_id)


def _release(spark: SparkSession, database: str, release: str) -> None:
    told = f"TBLPROPERTIES ('{RELEASE_PROPERTY}' = '{release}')"
    _define(spark, f"CREATE OR REPLACE VIEW {qualified(database, RELEASE_VIEW)} {told} AS SELECT '{release}' AS {RELEASE_PROPERTY}")


def properties(spark: SparkSession, database: str, table: str) -> dict[str, str]:
    """The properties of a table or view; none if it does not exist."""
    if not spark.catalog.tableExists(qualified(database, table)):
        return {}
    return {row["key"]: row["value"] for row in spark.sql(f"SHOW TBLPROPERTIES {qualified(database, table)}").collect()}


def released(spark: SparkSession, database: str) -> str | None:
    """The release that was published last."""
    return properties(spark, database, RELEASE_VIEW).get(RELEASE_PROPERTY)


def replace_table(
    df: DataFrame,
    database: str,
    table: str,
    partition_by: str | None = None,
    cluster_by: Sequence[str] = (),
    run_id: str | None = None,
    keep: int = 2,
) -> str:
    """Create or replace a table from a query; running it again leaves the same rows.

    The newest `keep` versions stay stored, for readers that still hold the one before.
    """
    run_id = run_id or new_run_id()
    write_version(df, database, table, run_id, partition_by, cluster_by)
    name = publish(df.sparkSession, database, table, run_id)
    drop_old_versions(df.sparkSession, database, table, keep)
    return name


def published_version(spark: SparkSession, database: str, table: str) -> str | None:
    """The run whose rows the public name shows; None if it shows none."""
    known = properties(spark, database, table)
    if PENDING_RELEASE in known and known[PENDING_RELEASE] == released(spark, database):
        return known[PENDING_VERSION]
    return known.get(VERSION_PROPERTY) or None


def versions(spark: SparkSession, database: str, table: str) -> list[str]:
    """Run ids with a stored version of the table, oldest first."""
    prefix = f"{table}__"
    names = [row["tableName"] for row in spark.sql(f"SHOW TABLES IN {qualified(database)} LIKE {literal(prefix + '*')}").collect()]
    return sorted(name[len(prefix) :] for name in names if name.startswith(prefix))


def drop_old_versions(spark: SparkSession, database: str, table: str, keep: int = 2) -> list[str]:
    """Drop all but the newest versions, never the published one."""
    published = published_version(spark, database, table)
    old = [v for v in versions(spark, database, table)[: -keep or None] if v != published]
    _drop_versions(spark, database, table, old)
    return old


def drop_unpublished(spark: SparkSession, database: str, tables: Sequence[str], run_id: str) -> None:
    """Drop what a failed run has stored and not published, and take it out of views that wait for its release."""
    for table in tables:
        if published_version(spark, database, table) == run_id:
            continue
        known = properties(spark, database, table)
        if known.get(PENDING_VERSION) == run_id:
            if known[VERSION_PROPERTY]:
                publish(spark, database, table, known[VERSION_PROPERTY])
            else:
                _define(spark, f"DROP VIEW {qualified(database, table)}")
        if run_id in versions(spark, database, table):
            _drop_versions(spark, database, table, [run_id])


def version_folder(spark: SparkSession, database: str, table: str, run_id: str) -> str:
    """Where a version whose folders can be shared is stored."""
    return f"{spark.catalog.getDatabase(qualified(database)).locationUri.rstrip('/')}/{table}__{run_id}"


def day_folders(df: DataFrame) -> dict[str, str]:
    """The folder of each day, `column=day`, of a table by days, wherever it lies."""
    return {folder.rsplit("/", 1)[1]: folder for folder in {unquote(file).rsplit("/", 1)[0] for file in df.inputFiles()}}


def write_days(
    df: DataFrame,
    database: str,
    table: str,
    run_id: str,
    base: str,
    days: Iterable[date],
    partition_by: str,
    cluster_by: Sequence[str] = (),
    measures: Sequence[Column] = (),
) -> tuple[str, dict[str, int]]:
    """A version with the given rows on the given days, and on all other days the rows of the version `base`.

    Only the given days are written; the others are partitions of the new table in the folders they are in. A day without rows has
    no partition.
    """
    spark, changed = df.sparkSession, {f"{partition_by}={day.isoformat()}" for day in days}
    unchanged = {day: folder for day, folder in day_folders(spark.table(version_name(database, table, base))).items() if day not in changed}
    name, measured = write_measured(df, database, table, run_id, partition_by, cluster_by, measures, version_folder(spark, database, table, run_id))
    specs = [f"PARTITION ({qualified(partition_by)} = {literal(day.split('=', 1)[1])}) LOCATION {literal(folder)}" for day, folder in sorted(unchanged.items())]
    for at in range(0, len(specs), ADDED_AT_ONCE):
        spark.sql(f"ALTER TABLE {name} ADD {' '.join(specs[at : at + ADDED_AT_ONCE])}")
    return name, measured


def _drop_versions(spark: SparkSession, database: str, table: str, run_ids: Sequence[str]) -> None:
    """Drop versions, and the day folders of dropped versions that no other version uses."""
    for run_id in run_ids:
        spark.sql(f"DROP TABLE IF EXISTS {version_name(database, table, run_id)}")
    stored = versions(spark, database, table)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    base = path(spark.catalog.getDatabase(qualified(database)).locationUri)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Tables that own their folder have taken it with them.
    own = [status.getPath() for status in files.listStatus(base)] if files.exists(base) else []
    left = [p for p in own if p.getName().startswith(f"{table}__") and p.getName()[len(table) + 2 :] not in stored and _RUN_ID.fullmatch(p.getName()[len(table) + 2 :])]
    if not left:
        return
    used = {path(f).toUri().getPath() for v in stored for f in day_folders(spark.table(version_name(database, table, v))).values()}
    for folder in left:
        inside = [status.getPath() for status in files.listStatus(folder)]
        unused = [p for p in inside if p.toUri().getPath() not in used]
        for p in unused if len(unused) < len(inside) else [folder]:
            files.delete(p, True)
