"""Parquet files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.contracts import BATCH_CLUSTER, BATCH_DAY, RAW_NAME
from fareloom.operators.tables import write_measured


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All files as one table; columns that only some of them have are NULL elsewhere.

    Files may hold a number in different widths: whole numbers are read as 64-bit integers and all others as doubles, and a
    column that is whole in one file and not in another becomes a double. A path that does not exist is an error.
    """
    files = [_widened(spark.read.parquet(path)) for path in paths]
    fractional = {f.name for df in files for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    files = [
        df.withColumns({f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema if f.name in fractional and isinstance(f.dataType, T.LongType)})
        for df in files
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), files)


def file_states(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int, int]]:
    """Name, length and time of change of all files of some paths: when they are the same, so is what is read."""
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    found = (path(unquote(file)) for file in sorted(spark.read.parquet(*paths).inputFiles()))
    states = (p.getFileSystem(conf).getFileStatus(p) for p in found)
    return [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in states]


def _widened(df: DataFrame) -> DataFrame:
    whole, other = (T.ByteType, T.ShortType, T.IntegerType), (T.FloatType, T.DecimalType)
    changes = {f.name: "bigint" for f in df.schema if isinstance(f.dataType, whole)}
    changes |= {f.name: "double" for f in df.schema if isinstance(f.dataType, other)}
    return df.withColumns({name: F.col(f"`{name}`").cast(kind) for name, kind in changes.items()})


def stage_batch(raw: DataFrame, database: str, table: str, run_id: str, measures: Sequence[Column] = ()) -> tuple[str, dict[str, int]]:
    """Store raw monthly rows by pickup day, clustered by zone and payment; the table's name, and what was measured on the way."""
    dated = raw.withColumn(BATCH_DAY, F.col(RAW_NAME["pickup_datetime"]).cast("date"))
    return write_measured(dated, database, table, run_id, BATCH_DAY, BATCH_CLUSTER, measures)
