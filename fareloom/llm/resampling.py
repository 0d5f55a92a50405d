"""Target-distribution importance resampling over hashed n-grams.

A text's features are its runs of 1 to `MOST` consecutive words, joined by one space, repeats counted; a feature's bucket is the
CRC-32 of its bytes modulo `BUCKETS`. The gain of a bucket compares how often the target texts and the documents fall into it;
a document's weight is the mean gain of its features, and Gumbel noise from its id turns the highest scores into a
draw without replacement.

CRC-32 is linear: the checksum of a span is the XOR of one contribution per byte, which depends on the byte and on how far
it is from the span's end, and of a constant that depends on the length. Contributions of distances below `REACH`
are looked up in a table, and `bitwise_xor.reduceat` folds them over all spans of a slice at once; longer spans are folded
blockwise, neighbouring blocks with each other, each time moving the left one on by the right one's length.

Tasks add up their own buckets, so the counts that are shuffled are `BUCKETS` rows a task, and the gains, `BUCKETS` numbers, are all the
driver holds. The draw needs ranks: eligible documents are dealt out by ranges of their order, each range is
numbered on its own and moved on by the sizes of those before it, so no task holds more than its range.

Words: A-Z in lower case, then runs of ASCII letters, digits and any non-ASCII characters. Defined results: null and empty texts
have no words, no features and weight 0; a null id counts as an empty one in the noise and comes after all others among equal
scores; repeated rows are documents of their own, ranked one after the other; an empty target or an empty table gives gains from the counts
that there are (0 + 1); other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.llm.common import keyed, slices, stored
from fareloom.llm.decontaminate import words_of

MOST = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
# Distances from a span's end with a table of their own.
REACH = 64
# Bytes of text that are folded at once, to keep the work arrays small.
STEP = 1 << 18


def _after_zero(state: np.ndarray) -> np.ndarray:
    """Checksum registers after one more zero byte."""
    for _ in range(8):
        state = np.where(state & np.uint32(1), (state >> np.uint32(1)) ^ np.uint32(0xEDB88320), state >> np.uint32(1))
    return state


@cache
def contributions() -> np.ndarray:
    """A byte's contribution by its distance from the end (row) and value (column)."""
    rows = [_after_zero(np.arange(256, dtype=np.uint32))]
    for _ in range(REACH - 1):
        rows.append(_after_zero(rows[-1]))
    return np.stack(rows)


@cache
def _moved_on(doublings: int) -> np.ndarray:
    """Four tables, one for each byte of a register: what it becomes after REACH * 2**doublings zero bytes."""
    if doublings:
        half = _moved_on(doublings - 1)
        return np.stack([move(row, half) for row in half])
    tables = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * n) for n in range(4)])
    for _ in range(REACH):
        tables = _after_zero(tables)
    return tables


def move(state: np.ndarray, tables: np.ndarray) -> np.ndarray:
    state = np.asarray(state, np.uint32)
    return tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]


@cache
def _short_constants() -> np.ndarray:
    return np.array([zlib.crc32(bytes(n)) for n in range(REACH)], np.uint32)


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """The checksum of as many zero bytes."""
    short = _short_constants()
    out = short[lengths % REACH]
    blocks, doublings = lengths // REACH, 0
    while (blocks >> doublings).any():
        at = np.flatnonzero(blocks >> doublings & 1)
        out[at] = ~move(~out[at], _moved_on(doublings))
        doublings += 1
    return out


def _folded(raw: np.ndarray) -> int:
    """The contributions of a long span, blocks of REACH bytes from its end, neighbours folded until one is left."""
    blocks = -(-len(raw) // REACH)
    padded = np.zeros(blocks * REACH, np.uint8)  # zero bytes in front contribute nothing
    padded[len(padded) - len(raw) :] = raw
    table = contributions()
    parts = np.bitwise_xor.reduce(table[np.arange(REACH)[::-1], padded.reshape(blocks, REACH)], axis=1)
    doublings = 0
    while len(parts) > 1:
        if len(parts) % 2:
            parts = np.append(np.uint32(0), parts)
        parts = move(parts[::2], _moved_on(doublings)) ^ parts[1::2]
        doublings += 1
    return int(parts[0])


def checksums(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans of a byte array; spans may overlap and must not be empty."""
    lengths = ends - begins
    out = length_constants(lengths)
    short = np.flatnonzero(lengths <= REACH)
    if len(short):
        size = lengths[short].astype(np.int32)
        upto = np.cumsum(size, dtype=np.int32)
        turn = np.arange(int(upto[-1]), dtype=np.int32)
        place = turn + np.repeat(begins[short].astype(np.int32) - (upto - size), size)
        distance = np.repeat(upto - 1, size) - turn
        values = contributions().reshape(-1)[(distance << 8) + raw[place]]
        out[short] ^= np.bitwise_xor.reduceat(values, upto - size)
    for n in np.flatnonzero(lengths > REACH).tolist():
        out[n] ^= np.uint32(_folded(raw[begins[n] : ends[n]]))
    return out


def _features(words: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by spaces as bytes, and where the features of each length begin and end."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    runs = [(begins[: len(words) - n], ends[n:]) for n in range(min(most, len(words)))]
    return raw, np.concatenate([a for a, _ in runs] or [begins]), np.concatenate([b for _, b in runs] or [ends])


def text_buckets(texts: list[str | None], most: int = MOST, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of words, owners, buckets) of the features of some texts at a time; owners count from the first of them.

    Texts are put together until they make a step, so that short ones share a fold; a long one is a step of its own.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    counts: list[int] = []
    size = 0
    for n, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        held.append(_features(words, most))
        size += len(held[-1][0])
        if size >= STEP or n == len(texts) - 1:
            shifts = np.cumsum([0, *(len(raw) for raw, _, _ in held)])
            raw = np.concatenate([raw for raw, _, _ in held])
            begins = np.concatenate([a + shift for (_, a, _), shift in zip(held, shifts, strict=False)])
            ends = np.concatenate([b + shift for (_, _, b), shift in zip(held, shifts, strict=False)])
            owners = np.repeat(np.arange(len(held)), [len(a) for _, a, _ in held])
            found = [checksums(raw, begins[i : i + STEP], ends[i : i + STEP]) for i in range(0, len(begins), STEP)]
            yield np.array(counts), owners, (np.concatenate(found) if found else np.zeros(0, np.uint32)) % np.uint32(buckets)
            held, counts, size = [], [], 0


def bucket_counts(texts: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (one column) fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, 0):
            for _, _, found in text_buckets(part.column(0).to_pylist(), most, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    counted = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for each bucket."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    size = float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, most: int = MOST) -> DataFrame:
    """(id, n_words, n_features, weight) for rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            at = 0
            for words, owners, found in text_buckets(part.column(1).to_pylist(), most, len(gains)):
                features = np.bincount(owners, minlength=len(words))
                # Whole numbers that are exact in doubles: below 2**53 for any text that fits into memory.
                total = np.bincount(owners, gains[found], len(words)).astype(np.int64)
                weight = total // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(words)), *(pa.array(x.astype(np.int64)) for x in (words, features, weight))], names)
                at += len(words)

    names = ["id", "n_words", "n_features", "weight"]
    fields = [T.StructField("id", docs.schema["id"].dataType), *(T.StructField(n, T.LongType()) for n in names[1:])]
    return docs.mapInArrow(run, T.StructType(fields))


def numbered(df: DataFrame, order: list) -> DataFrame:
    """`df` with `rank`, 1 and on in the given order over all rows, without one task for all of them.

    Rows are dealt out by ranges of the order, sorted inside, and stored with their range and place; a range's first rank
    follows from the sizes of the ranges before it, one number for each.
    """
    place = F.monotonically_increasing_id()  # the task's number above its 33 lowest bits, the row's place in them
    dealt = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place), "ranges")
    dealt = dealt.withColumns({"range": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)})
    sizes = dealt.groupBy("range").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("range", before.alias("before"))  # as many rows as a shuffle has partitions
    return dealt.join(F.broadcast(firsts), "range").withColumn("rank", F.col("before") + F.col("place") + 1).drop("range", "place", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", most: int = MOST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per document: id, n_features, weight, score and rank; rank is null for documents that are not drawn.

    Of the documents of at least `least_words` words, `percent` in a hundred are drawn, the highest scores first, ties to the smaller id.
    """
    source = keyed(docs, id_col, text_col)
    gains = bucket_gains(bucket_counts(source.select("text"), most, buckets), bucket_counts(target.select(F.col(f"`{target_text_col}`").cast("string")), most, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(-1000.0 * F.log(-F.log(uniform)))
    # The salt keeps repeated rows apart, so that a range never has to hold all of them.
    rows = stored(weigh(source, gains, most).withColumns({"score": score, "salt": F.monotonically_increasing_id()}), "weights")
    eligible = rows.where(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    level = F.shiftright("score", 4)
    least = _least_level(eligible.groupBy(level.alias("level")).agg(F.count("*").alias("rows")), drawn)
    high = (F.col("n_words") >= least_words) & (level >= least)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.desc("n_features"), F.asc("salt")]
    first = numbered(rows.where(high), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    both = first.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long")))
    return both.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def _least_level(sizes: DataFrame, count: int) -> int:
    """The highest level that has, with all above it, `count` rows; scores have a bounded range, so there are few levels."""
    upto = F.sum("rows").over(Window.orderBy(F.desc("level")))
    enough = sizes.select("level", upto.alias("upto")).where(F.col("upto") >= count)
    return enough.agg(F.max("level")).first()[0] or 0


# The same rows in SQL for an independent engine.
SQL = r"""
WITH steps AS (
  SELECT [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
          for n in range(CAST(0 AS BIGINT), CAST(256 AS BIGINT))] AS t),
words AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
goals AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
runs AS (SELECT r, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS f FROM words),
goal_runs AS (SELECT unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS f FROM goals),
spelled AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM runs UNION SELECT f FROM goal_runs)),
codes AS (
  SELECT f, xor(list_reduce([4294967295] || [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) for i in range(0, len(h) // 2)],
                            lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM spelled, steps),
ours AS (SELECT bucket, count(*) AS s FROM runs JOIN codes USING (f) GROUP BY bucket),
theirs AS (SELECT bucket, count(*) AS t FROM goal_runs JOIN codes USING (f) GROUP BY bucket),
sums AS (SELECT CAST((SELECT count(*) FROM runs) AS DOUBLE) AS s_all, CAST((SELECT count(*) FROM goal_runs) AS DOUBLE) AS t_all),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM ours LEFT JOIN theirs USING (bucket), sums),
weights AS (
  SELECT r, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM runs JOIN codes USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (r)),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features DESC) AS rank, count(*) OVER () AS eligible FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN rank <= 25 * eligible // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""
