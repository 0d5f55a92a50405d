"""Benchmark decontamination with a positional inverted index.

Documents are the training side, items the test side. One pass counts how often each test term occurs in training;
a second one stores the postings (document row, position) of the two rarest terms of each window of test words.
Lists are moved by the terms' offsets in the window and intersected by joins, the rarest first, so a window costs
as much as its rarest term is frequent. The rarest term's posting also holds the words around it; comparing these
word by word makes every match an exact phrase match. `proximity` asks the same index for terms that stand close.

Test items are a stated query set: they are read in blocks of at most `BLOCK_BYTES` of text, so what a task or the
driver holds of them is bounded; all blocks run over all rows, and their hits are put together.

Words: A-Z in lower case, then runs of ASCII letters, digits and any non-ASCII characters. Defined results: null and
empty texts have no words and no hits; an item without words has no window; an item without an id hits but is not
counted or listed; repeated document rows are judged one by one; repeated item rows count once; other columns are
not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.llm.common import keyed, slices, stored

WIDTH = 13
BLOCK_BYTES = 4 << 20
# A second list is worth intersecting if it is at most so many times as long as the rarest one.
WORTH = 16

_WORD_BYTES = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(128, 256))
_FOLD = bytes(c if (c := ord(chr(b).lower()) if 65 <= b <= 90 else b) in _WORD_BYTES else 32 for b in range(256))

POSTING = "struct<term:int,pos:int,before:int,around:string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The test items as word lists, in blocks of bounded size."""
    block, held = [], 0
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    for row in rows.toLocalIterator():
        found = words_of(row.text)
        if found:
            block.append((row.id, found))
            held += len(row.text) + 64
        if held > most:
            yield block
            block, held = [], 0
    if block:
        yield block


def windows_of(block: list[tuple[str | None, list[bytes]]], width: int) -> dict[tuple[bytes, ...], set[str]]:
    """Each distinct window of a block and the items that have it."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, words in block:
        for at in range(max(1, len(words) - width + 1)):
            found.setdefault(tuple(words[at : at + width]), set()).update(() if item is None else (item,))
    return found


def term_counts(docs: DataFrame, terms: frozenset[bytes]) -> dict[bytes, int]:
    """Occurrences of the given terms over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for part in slices(batches, 1):
            for text in part.column(1).to_pylist():
                total.update(filter(terms.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    counted = docs.mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in counted.collect()}


def index(docs: DataFrame, lead: dict[bytes, int], other: dict[bytes, int], width: int) -> DataFrame:
    """Per document row: id, number of words and the postings of the wanted terms.

    Postings of `lead` terms have up to `width - 1` words on both sides, joined by spaces, and how many stand before.
    """
    wanted = frozenset(lead) | frozenset(other)
    number = {t: n for n, t in enumerate(sorted(wanted))}
    reach = width - 1

    def posting(words: list[bytes], at: int) -> dict:
        word = words[at]
        if word not in lead:
            return {"term": number[word], "pos": at, "before": None, "around": None}
        begin = max(0, at - reach)
        return {"term": number[word], "pos": at, "before": at - begin, "around": b" ".join(words[begin : at + width]).decode()}

    kind = pa.list_(pa.struct([("term", pa.int32()), ("pos", pa.int32()), ("before", pa.int32()), ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            counts, postings = [], []
            for text in part.column(2).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                postings.append([posting(words, at) for at, w in enumerate(words) if w in wanted])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(postings, kind)], ["row", "id", "n_words", "postings"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    fields = [T.StructField("row", T.LongType()), T.StructField("id", source.schema["id"].dataType), T.StructField("n_words", T.LongType())]
    schema = T.StructType([*fields, T.StructField("postings", T.ArrayType(T._parse_datatype_string(POSTING)))])
    return source.mapInArrow(run, schema)


def plan_windows(windows: dict[tuple[bytes, ...], set[str]], counts: dict[bytes, int]) -> list[tuple]:
    """For each window that can occur: its rarest term and offset, and a second pair worth intersecting, else the same."""
    planned = []
    for words in windows:
        order = sorted(range(len(words)), key=lambda i: (counts.get(words[i], 0), words[i], i))
        first, second = order[0], order[min(1, len(order) - 1)]
        if not counts.get(words[first]):
            continue
        if counts[words[second]] > WORTH * counts[words[first]]:
            second = first
        planned.append((words, first, second))
    return planned


def _starts(postings: DataFrame, windows: DataFrame, term: str, offset: str) -> DataFrame:
    joined = postings.join(F.broadcast(windows), postings["term"] == windows[term])
    return joined.withColumn("start", F.col("pos") - F.col(offset)).where("start >= 0")


def _phrase() -> Column:
    inside = F.slice(F.split("around", " "), F.col("before") - F.col("first_at") + 1, F.col("size"))
    return F.array_join(inside, " ") == F.col("words")


def block_hits(docs: DataFrame, block: list, width: int, base: int) -> tuple[DataFrame, DataFrame]:
    """Rows of all documents (row, id, n_words), and exact hits (row, start, size, item) of a block's windows."""
    spark = docs.sparkSession
    windows = windows_of(block, width)
    counts = term_counts(docs, frozenset(w for window in windows for w in window))
    planned = plan_windows(windows, counts)
    lead = {words[a]: 0 for words, a, _ in planned}
    other = {words[b]: 0 for words, _, b in planned}
    rows = stored(index(docs, lead, other, width), "index")
    number = {t: n for n, t in enumerate(sorted(lead | other))}
    table = [(base + n, len(words), b" ".join(words).decode(), number[words[a]], a, number[words[b]], b) for n, (words, a, b) in enumerate(planned)]
    frame = spark.createDataFrame(table, "window long, size int, words string, first int, first_at int, second int, second_at int")
    members = [(base + n, item) for n, (words, _, _) in enumerate(planned) for item in sorted(windows[words]) or [None]]
    owners = spark.createDataFrame(members, "window long, item string")

    postings = rows.select("row", F.explode("postings").alias("p")).select("row", "p.*")
    first = _starts(postings.where("around IS NOT NULL"), frame.drop("second", "second_at"), "first", "first_at").where(_phrase())
    second = _starts(postings, frame.where("second_at <> first_at").select("window", "second", "second_at"), "second", "second_at")
    alone = frame.where("second_at = first_at").select("window")
    both = first.join(second.select("row", "window", "start"), ["row", "window", "start"], "left_semi")
    hits = both.unionByName(first.join(F.broadcast(alone), "window", "left_semi")).select("row", "start", "size", "window")
    return rows.drop("postings"), hits.join(F.broadcast(owners), "window").select("row", "start", "size", "item")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of a window; a document is contaminated if at least a twentieth
    of its words, and one, are hit.
    """
    source = keyed(docs, id_col, text_col)
    found = [block_hits(source, block, width, n << 32) for n, block in enumerate(item_blocks(items, item_id_col, item_text_col))]
    if not found:
        found = [(index(source, {}, {}, width).drop("postings"), docs.sparkSession.createDataFrame([], "row long, start int, size int, item string"))]
    rows = found[0][0]
    hits = reduce(DataFrame.unionByName, [h for _, h in found])
    spans = hits.groupBy("row", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    covered = spans.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    owners = hits.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        rows.join(covered, "row", "left")
        .join(owners, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """The documents, with all their columns, that are not contaminated; equal rows share their result."""
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.md5(F.col(f"`{text_col}`").cast("string")).alias("text"))
    judged = decontaminate(docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("body")), items, "key", "body", **named)
    bad = judged.where("contaminated").select("key.*").distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), key.alias("key"))
    same = whole["key.id"].eqNullSafe(bad["id"]) & (whole["key.text"] == bad["text"])
    return whole.join(bad, same, "left_anti").select("whole.*")


def proximity(docs: DataFrame, terms: list[str], within: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places (id, pos) of the rarest of the terms with every other term at most `within` words away, in any order."""
    source = keyed(docs, id_col, text_col)
    wanted = frozenset(w for t in terms for w in words_of(t))
    counts = term_counts(source, wanted)
    order = sorted(wanted, key=lambda t: (counts.get(t, 0), t))
    rows = stored(index(source, {}, dict.fromkeys(wanted, 0), 1), "index")
    number = {t: n for n, t in enumerate(sorted(wanted))}
    postings = rows.select("row", "id", F.explode("postings").alias("p")).select("row", "id", "p.term", "p.pos", F.floor(F.col("p.pos") / (within + 1)).alias("cell"))
    found = postings.where(F.col("term") == number[order[0]]) if order else postings
    for term in order[1:]:
        near = postings.where(F.col("term") == number[term]).select("row", F.col("pos").alias("near"), F.explode(F.array(*(F.col("cell") + d for d in (-1, 0, 1)))).alias("cell"))
        found = found.join(near, (found["row"] == near["row"]) & (found["cell"] == near["cell"]) & (F.abs(found["pos"] - near["near"]) <= within), "left_semi")
    return found.select(F.col("id").alias(id_col), "pos")


# The same rows in SQL for an independent engine.
SQL = r"""
WITH letters AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
tests AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM tests WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
places AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM letters, sizes)),
hits AS (SELECT r, i, places.size, item_id FROM places JOIN wins ON places.size = wins.size AND places.phrase = wins.phrase),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r),
owners AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM letters LEFT JOIN covered USING (r) LEFT JOIN owners USING (r)
"""
