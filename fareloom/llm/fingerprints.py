"""Document fingerprints by locally consistent parsing.

A text is a string of bytes. On each level runs of one symbol become one symbol; deterministic coin tossing then
colours the string: a symbol's colour is the lowest bit in which it differs from the one before, and that bit's value,
and a few repetitions leave fewer than eight colours, no two alike side by side. Phrases begin at local maxima
of the colours, and a phrase is named by a hash of its symbols. Colours depend on a few symbols around, so equal
substrings are cut alike inside, wherever they stand, and share the names of their interior phrases.

A fingerprint has the name of the whole text and bottom-k sketches of the phrases of two levels (about 9 and 27
bytes). Likeness is the estimated Jaccard similarity of these phrase sets, the longer ones counting three times.

Defined results: null is the empty text; empty texts have one fingerprint; equal texts have equal fingerprints and
likeness 1; rows with equal ids are ordered by their text, rows without id come last; other columns are not looked at.
Rows meet their successor in ranges of ids, each one sorted in its own task; a range also gets the first row of the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.llm.common import keyed, mix, slices

LEVELS = ((2, 16), (3, 48))
COLOURINGS = 4
_BASE = np.uint64(0xD1342543DE82EF95)
_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(63, _BASE)]))


def _before(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol before each one; before the first of a row, one that differs in the lowest bit."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = ~x[first]
    return out


def parse(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the symbols of all rows (row r has rows[r] to rows[r + 1]) to phrase names and their rows."""
    if not len(x):
        return np.zeros(0, np.uint64), rows
    first = rows[:-1][rows[:-1] < rows[1:]]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[first] = True
    at = np.flatnonzero(new)
    names = x[at].astype(np.uint64)
    if len(at) < len(x):
        run = np.diff(np.append(at, len(x)))
        long = run > 1
        names[long] = mix(names[long] + run[long].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        x, rows = x[at], np.searchsorted(at, rows)
        if x.dtype == np.uint64:
            x = names
        first = rows[:-1][rows[:-1] < rows[1:]]
    colour = x
    for _ in range(COLOURINGS):
        differ = colour ^ _before(colour, first)
        low = differ & (~differ + differ.dtype.type(1))
        colour = ((np.bitwise_count(low - low.dtype.type(1)).astype(np.uint8) << 1) | ((colour & low) != 0)).astype(np.uint8)
    top = np.zeros(len(x), bool)
    top[1:-1] = (colour[1:-1] > colour[:-2]) & (colour[1:-1] > colour[2:])
    last = np.append(first[1:], len(x)) - 1
    top[last] = False
    top[first] = True
    starts = np.flatnonzero(top)
    place = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    return mix(np.add.reduceat((names + np.uint64(1)) * _POWERS[place & 63], starts)), np.searchsorted(starts, rows)


def _smallest(names: np.ndarray, rows: np.ndarray, most: int) -> list[str]:
    """Per row the `most` smallest 32-bit hashes of its distinct names, as hexadecimal text."""
    keys = np.unique((np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows)) << np.uint64(32)) | (mix(names) >> np.uint64(32)))
    bounds = np.searchsorted(keys, np.arange(len(rows), dtype=np.uint64) << np.uint64(32))
    text = (keys & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
    return [text[8 * a : 8 * min(b, a + most)] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]


def fingerprints(texts: list[bytes]) -> list[str]:
    """Name of the text, then a sketch per level, joined by dashes."""
    rows = np.cumsum([0, *map(len, texts)])
    x, sketches = np.frombuffer(b"".join(texts), np.uint8), []
    level, wanted = 0, dict(LEVELS)
    while level <= max(wanted) or np.any(np.diff(rows) > 1):
        x, rows = parse(x, rows)
        level += 1
        if level in wanted:
            sketches.append(_smallest(x, rows, wanted[level]))
        if level == max(wanted):
            single = x, rows
    # Rows end on different levels; the name of a row is taken on the first one where it has one phrase.
    roots = _roots(*single)
    return ["-".join(parts) for parts in zip(roots, *sketches, strict=True)]


def _roots(x: np.ndarray, rows: np.ndarray) -> list[str]:
    found = np.zeros(len(rows) - 1, np.uint64)
    left = np.arange(len(rows) - 1)
    while len(left):
        sizes = np.diff(rows)
        done = sizes <= 1
        has = sizes == 1
        found[left[has]] = x[rows[:-1][has]]
        keep = np.repeat(~done, sizes)
        x, left, sizes = x[keep], left[~done], sizes[~done]
        x, rows = parse(x, np.concatenate([[0], np.cumsum(sizes)]))
    return [f"{v:016x}" for v in found.tolist()]


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    total = 0.0
    for (_, most), weight, x, y in zip(LEVELS, (0.25, 0.75), a.split("-")[1:], b.split("-")[1:], strict=True):
        p, q = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (x, y))
        union = sorted(p | q)[:most]
        total += weight * (sum(u in p and u in q for u in union) / len(union) if union else 1.0)
    return total


def _place(cuts: list[int], column: Column) -> Column:
    """Index of the last of the descending cuts that is not below the value, found by halving; null if it is null."""
    table = F.split(F.lit(" ".join(map(str, cuts))), " ").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << n) for n in reversed(range(max(1, len(cuts).bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step) >= column, at + step).otherwise(at))


def ranges(df: DataFrame, parts: int) -> DataFrame:
    """Rows (part, halo, id, text) so that each part has a range of descending ids and, as halo, the row that follows it."""
    shares = [n / parts for n in range(1, parts)]
    quantiles = F.percentile_approx("id", shares, 10_000) if shares else F.array().cast("array<bigint>")
    row = df.agg(F.max("id").alias("top"), quantiles.alias("cuts")).first()
    cuts = sorted({row.top, *(row.cuts or [])} - {None}, reverse=True)
    if not cuts:
        cuts = [0]
    last = len(cuts) - 1
    part = F.when(F.col("id").isNull(), F.lit(last)).otherwise(_place(cuts, F.col("id")))
    placed = df.withColumn("part", part)
    table = F.split(F.lit(" ".join(map(str, cuts))), " ").cast("array<bigint>")
    only_null = row.top is None
    is_top = F.lit(True) if only_null else F.col("id") == F.get(table, F.col("part"))
    before = F.when(F.col("part") == 0, F.lit(last)).otherwise(F.col("part") - 1)
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("halo"))
    copies = F.when(is_top, F.array(here, F.struct(before.alias("part"), F.lit(True).alias("halo")))).otherwise(F.array(here))
    return placed.select(F.explode(copies).alias("c"), "id", "text").select("c.part", "c.halo", "id", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    The edited text has the last half of its code points replaced by as many first ones of the next document.
    """
    source = keyed(docs, id_col, text_col).withColumns({"id": F.col("id").cast("long"), "text": F.coalesce("text", F.lit(""))})
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = ranges(source, parts).repartition(parts, "part").sortWithinPartitions("part", "halo", F.col("id").desc_nulls_last(), "text")
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows_of(held: list[tuple]) -> pa.RecordBatch:
        """Rows for all but the last one held, which is only somebody's next."""
        own = fingerprints([t.encode() for *_, t in held])
        out = [i for i, (_, halo, _, _) in enumerate(held[:-1]) if not halo]
        edited = []
        for i in out:
            text, following = held[i][3], held[i + 1][3]
            half = len(text) // 2
            edited.append((text[: len(text) - half] + following[:half]).encode())
        theirs = fingerprints(edited)
        columns = [
            pa.array([held[i][2] for i in out], pa.int64()),
            pa.array([len(held[i][3]) for i in out], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array([own[i] for i in out], pa.string()),
            pa.array(theirs, pa.string()),
            pa.array([likeness(own[i], t) for i, t in zip(out, theirs, strict=True)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in out], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in slices(batches, 3, 1 << 19):
            held += zip(*(c.to_pylist() for c in part.columns), strict=True)
            yield rows_of(held)
            held = held[-1:]

    kinds = [T.LongType(), T.LongType(), *[T.StringType()] * 3, T.DoubleType(), T.DoubleType()]
    return placed.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
