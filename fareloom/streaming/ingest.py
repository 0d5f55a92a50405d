"""Bounded ingestion of event files into the stream staging table.

A batch is a folder of its own, by outcome and day: `staged` rows, and `rejected` ones with the rule they break, written in one
pass. When the folder is complete, the commit log of the target gets one file for it, which names the days it holds. Readers see the
batches of the log only, and no folder of a batch is listed for them; a batch that broke half-way, or is being written, is not
there. A batch in the log is never written again.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.config import TripRules
from fareloom.contracts import STREAM_SCHEMA
from fareloom.operators.rules import broken_trip, first_broken_rule
from fareloom.operators.tables import ADDED_AT_ONCE, clustered, literal, qualified

# A hundred years: no file is too old to be new.
OLDEST = "36500d"
BATCH, OUTCOME, DAY, RULE = "batch", "outcome", "pickup_date", "broken_rule"
STAGED, REJECTED = "staged", "rejected"
LOG = "_batches"


def to_stream_contract(events: DataFrame) -> DataFrame:
    """Cast events to the staging contract; every event comes through."""
    return events.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in STREAM_SCHEMA.fields))


def without_broken(events: DataFrame, rules: TripRules) -> DataFrame:
    """Leave out events that provably break a trip rule, as the publisher of the stream is expected to."""
    return events.where(~F.coalesce(broken_trip(rules), F.lit(False)))


def ingest_events(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    target: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda events: events,
    bytes_per_batch: int = 256 * 2**30,
    rules: TripRules | None = None,
) -> None:
    """Append the event files not yet seen to `target`, then stop.

    A file is new if no run with this checkpoint has read it, however old it is: the age limit of the file source is set far
    beyond any retention. Batches are bounded by bytes, so a long backlog is worked off in steps that each commit. Every
    batch is written to a folder of its own, named by its number and checkpoint, with its rows brought together by day, and written
    again from scratch if it has to be repeated before it is in the log, so a restart or a second run adds nothing twice
    and files do not multiply with tasks. With `rules`, events that provably break one are set aside with its name; all others are staged. There
    is no state; duplicates are resolved later by key.
    """
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).option("maxFileAge", OLDEST)
    origin = sha256(checkpoint.encode()).hexdigest()[:12]
    query = (
        to_stream_contract(prepare(reader.parquet(source)))
        .writeStream.foreachBatch(lambda batch, number: write_batch(batch, target, f"{number}-{origin}", rules))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def write_batch(batch: DataFrame, target: str, name: str, rules: TripRules | None = None) -> None:
    """Store one batch and put it into the log, unless it is there already."""
    spark = batch.sparkSession
    files, path = _files(spark, target)
    if files.exists(path(f"{target}/{LOG}/{name}")):
        return
    rule = first_broken_rule(rules) if rules else F.lit(None).cast("string")
    marked = batch.withColumn(RULE, rule).withColumn(OUTCOME, F.when(F.col(RULE).isNull(), STAGED).otherwise(REJECTED))
    folder = f"{target}/{BATCH}={name}"
    writer = clustered(marked, DAY, (OUTCOME,)).write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(OUTCOME, DAY).parquet(folder)
    _commit(spark, target, name, folder)


def _files(spark: SparkSession, target: str):
    """The file system of a folder, and how it names paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _commit(spark: SparkSession, target: str, name: str, folder: str) -> None:
    """One log file, a line for each outcome and day of the batch; it appears as a whole, by a rename."""
    files, path = _files(spark, target)
    inside = lambda at: [s.getPath() for s in files.listStatus(path(at)) if s.isDirectory()]
    lines = [f"{outcome.getName()}/{day.getName()}" for outcome in inside(folder) for day in inside(outcome.toString())]
    files.mkdirs(path(f"{target}/{LOG}"))
    draft = path(f"{target}/{LOG}/.{name}")
    out = files.create(draft, True)
    out.write(bytearray("".join(f"{line}\n" for line in sorted(lines)).encode()))
    out.close()
    if not files.rename(draft, path(f"{target}/{LOG}/{name}")):
        raise OSError(f"batch {name} could not be put into the log of {target}")


def committed_batches(spark: SparkSession, target: str) -> list[str]:
    """The names of the finished batches."""
    files, path = _files(spark, target)
    log = path(f"{target}/{LOG}")
    names = [s.getPath().getName() for s in files.listStatus(log)] if files.exists(log) else []
    return sorted(n for n in names if not n.startswith("."))


def _partitions(spark: SparkSession, target: str, names: list[str]) -> list[tuple[str, str, str]]:
    """(batch, outcome, day) of everything that some batches hold, from the log alone; a day may be unknown."""
    if not names:
        return []
    lines = spark.read.text([f"{target}/{LOG}/{name}" for name in names]).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return sorted((r["name"], *(part.split("=", 1)[1] for part in r["value"].split("/"))) for r in lines.collect())


def _read(spark: SparkSession, target: str, outcome: str) -> DataFrame:
    fields = [*STREAM_SCHEMA.fields, T.StructField(RULE, T.StringType()), T.StructField(BATCH, T.StringType()), T.StructField(OUTCOME, T.StringType())]
    names = committed_batches(spark, target)
    if not names:
        return spark.createDataFrame([], T.StructType(fields))
    reader = spark.read.schema(T.StructType(fields)).option("basePath", target)
    return reader.parquet(*(f"{target}/{BATCH}={name}" for name in names)).where(F.col(OUTCOME) == outcome)


def read_staged(spark: SparkSession, target: str) -> DataFrame:
    """The staged rows of all finished batches."""
    return _read(spark, target, STAGED).select(*STREAM_SCHEMA.names)


def read_rejected(spark: SparkSession, target: str) -> DataFrame:
    """The rows of finished batches that were set aside, with the batch and the rule they break."""
    return _read(spark, target, REJECTED).select(*STREAM_SCHEMA.names, RULE, BATCH)


def register_staged(spark: SparkSession, database: str, table: str, target: str) -> str:
    """Give the staged files of the finished batches a table name; without any event the table is there and empty.

    Registering again adds what the log has got since; what is known already is not looked at.
    """
    name, files = qualified(database, table), qualified(database, f"{table}__files")
    columns = ", ".join(f"{qualified(f.name)} {f.dataType.simpleString()}" for f in STREAM_SCHEMA.fields)
    known: set[str] = set()
    if spark.catalog.tableExists(files):
        shown = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {files}").collect()}
        if shown.get("target") == target:
            known = {r["partition"].split("/", 1)[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {files}").collect()}
        else:
            spark.sql(f"DROP TABLE {files}")
    folder, path = _files(spark, target)
    folder.mkdirs(path(target))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {files} ({columns}, {RULE} STRING, {BATCH} STRING, {OUTCOME} STRING) USING parquet "
        f"PARTITIONED BY ({BATCH}, {OUTCOME}, {DAY}) LOCATION {literal(target)} TBLPROPERTIES ('target' = {literal(target)})"
    )
    fresh = [n for n in committed_batches(spark, target) if n not in known]
    specs = []
    for batch, outcome, day in _partitions(spark, target, fresh):
        value = "null" if day == "__HIVE_DEFAULT_PARTITION__" else literal(day)
        specs.append(f"PARTITION ({BATCH} = {literal(batch)}, {OUTCOME} = {literal(outcome)}, {DAY} = {value}) LOCATION {literal(f'{target}/{BATCH}={batch}/{OUTCOME}={outcome}/{DAY}={day}')}")
    for at in range(0, len(specs), ADDED_AT_ONCE):
        spark.sql(f"ALTER TABLE {files} ADD IF NOT EXISTS {' '.join(specs[at : at + ADDED_AT_ONCE])}")
    names = ", ".join(map(qualified, STREAM_SCHEMA.names))
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {names} FROM {files} WHERE {OUTCOME} = '{STAGED}'")
    return name
