"""Helpers that several operators of this package share."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.session import scratch_path

# Bytes that end a word: the ASCII white space U+0020 and U+0009 to U+000D.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Whether shuffle files are cleaned up after a step; small tests can do without.
TIDY = True


def stored(df: DataFrame, label: str, tidy: bool = True) -> DataFrame:
    """`df` written as Parquet to the shared scratch folder and read again.

    It cuts the lineage, so that a lost executor costs tasks of later steps only. The collections afterwards
    let Spark's cleaner remove shuffle files of steps that nothing refers to any more; the first one frees the plan,
    and a shuffle is free once the cleaner has seen to that. Steps whose shuffles are small can do without (`tidy`).
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    if tidy and TIDY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()
    return again


def forget(df: DataFrame) -> None:
    """Remove the files of a stored table once nothing reads it any more, also not by way of an unfinished step."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator works on, under names of its own; other columns cannot clash."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `most_bytes` of the given text column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // most_bytes)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(begin, end - begin)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, null as empty, and the row offsets into them."""
    packed = pa.concat_arrays([column.cast(pa.large_binary()).fill_null(b"")])
    offsets = np.frombuffer(packed.buffers()[1], dtype=np.int64)[packed.offset : packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, count: int) -> np.ndarray:
    table = np.full(max(count, 1), base, dtype=np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


class Words:
    """The words of a text column as arrays: byte ranges, 64-bit hashes and the words of each row.

    A word is a maximal run of bytes outside `ends` within one row. `seeds` gives one hash per seed; hashes with
    different seeds are independent.
    """

    def __init__(self, column: pa.Array, ends: np.ndarray = SPACES, seeds: tuple[int, ...] = (0x9E3779B97F4A7C15,)):
        self.raw, self.row_bytes = text_bytes(column)
        inside = ~ends[self.raw] if len(self.raw) else np.zeros(0, bool)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = self.row_bytes[:-1][self.row_bytes[:-1] < self.row_bytes[1:]]
        begins[at] = inside[at]
        self.starts = np.flatnonzero(begins)
        self.rows = np.searchsorted(self.starts, self.row_bytes)
        if not len(self.starts):
            self.sizes, self.hashes = np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in seeds]
            return
        self.sizes = np.add.reduceat(inside, self.starts, dtype=np.int64)
        head, place = int(self.starts[0]), np.zeros(len(self.raw), np.int64)
        place[head:] = np.arange(head, len(self.raw)) - np.repeat(self.starts, np.diff(np.append(self.starts, len(self.raw))))
        place[~inside] = 0
        letters = np.where(inside, self.raw, 0).astype(np.uint64)
        letters[inside] += np.uint64(1)
        self.hashes = []
        for seed in seeds:
            weights = _powers(seed | 1, int(self.sizes.max()) + 1)
            sums = np.add.reduceat(letters * weights[place], self.starts)
            self.hashes.append(mix(sums + self.sizes.astype(np.uint64) * np.uint64(seed | 1)))


def rolling(hashes: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit hash of each `width` consecutive values; as many as there are whole windows."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for shift in range(width):
        out *= np.uint64(base)
        out += hashes[shift : shift + len(out)]
    return mix(out)
