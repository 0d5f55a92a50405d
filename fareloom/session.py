"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
from functools import cache
from uuid import uuid4

from pyspark.sql import SparkSession

# UTC keeps `current_timestamp` and string casts the same on every host. The
# advisory size is what adaptive execution aims at per task and per written file. Every shuffle starts with
# INITIAL_PARTITIONS partitions, which adaptive execution merges up to that size and never splits by itself:
# 20,000 suit shuffles of up to 5 TB; raise it with the input (`cluster_settings`).
INITIAL_PARTITIONS = 20_000
SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(INITIAL_PARTITIONS),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
}


def cluster_settings(initial_partitions: int = INITIAL_PARTITIONS) -> dict[str, str]:
    """Settings of a cluster session whose largest shuffle is about `initial_partitions` times 256 MB."""
    return {**SETTINGS, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial_partitions)}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fareloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Test tables are tiny; without this one task would create all day files one by one.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
    )
    for key, value in cluster_settings(shuffle_partitions).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="fareloom-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the folder the cluster shares for checkpoints.

    The folder comes from ``spark.checkpoint.dir``. Only a local session may go
    without it; executors on other hosts could not see a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = _local_folder()
    own = f"{shared.rstrip('/')}/fareloom/{spark.sparkContext.applicationId}"
    _remove_at_exit(spark, own)
    return f"{own}/{label}-{uuid4().hex}"


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver remove its own scratch folder when it ends; the folder has to exist to be noted."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
