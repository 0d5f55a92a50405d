"""Ranked lexical search with pair-bound MaxScore over blocks of documents.

Queries are a stated set of items, read in blocks of bounded size; all documents are searched for each of them.

1. Documents are cut into blocks of about `BLOCK_BYTES` of text. A block's row holds, for each of its documents, how often
   each query term occurs. Document counts, total length and document frequencies are sums over these rows.
2. The index has a term's impact (its share of a score) for each document of a block, and for pairs of terms the joint
   maximum over the documents that hold both, with the document that reaches it. The terms of an item stand in a
   chain, rarest first; its pairs are the neighbours in the chain.
3. The documents of joint maxima are scored first. The score that `top` of them reach in all blocks together is a limit
   that no document below it can pass.
4. A pair's bound is the largest of its joint maximum and the two single maxima, as a document has both terms or one at
   most. The bound of the chain from any term on is the least sum of single and pair bounds that covers it
   (two candidates a step), which is at most the sum of term maxima. A block whose bound is below the limit is skipped;
   in others only documents that hold a term before the part of the chain that stays below the limit are looked at, and they
   are dropped as soon as score and bound of the rest are below it. What a task finds raises its own limit.

Every step maps blocks to a few rows, tasks keep at most `top` rows per item, and the last step ranks those; a term that
all documents hold is spread over all blocks. Nothing is dropped but what can't be among the first.

Words: runs of ASCII letters, digits and any non-ASCII characters, A-Z in lower case. Defined results: null and empty texts have
no terms and are not found; items without terms have no rows; each item row is an item, repeated ones have their rows repeated, and a
null item id stays null; repeated documents are ranked one by one; equal scores go by id, nulls last; scores of 0 are not
listed; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.llm.common import keyed, slices, stored
from fareloom.llm.decontaminate import words_of

TOP = 20
BLOCK_BYTES = 4 << 20
# Terms of items, repeated for each item, that are searched for at once; they bound what the driver and a task hold.
ENTRIES = 100_000


class Item:
    """A query: the numbers of its terms in chain order, how often each is asked for, and its pairs' numbers."""

    def __init__(self, terms: np.ndarray, times: np.ndarray):
        self.terms, self.times = terms, times
        self.pairs = np.zeros(0, np.int64)


class Queries:
    """A block of items over a common list of terms; weights and pairs follow once the terms have been counted."""

    def __init__(self, counts: list[Counter[bytes]]):
        self.number = {t: n for n, t in enumerate(sorted(set().union(*counts)))}
        self.counts = counts

    def weigh(self, frequencies: np.ndarray, documents: int, length: int) -> None:
        self.documents, self.length = documents, length
        self.weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * frequencies + 1))).astype(np.int64)
        known: dict[tuple[int, int, int, int], int] = {}
        self.items = []
        for count in self.counts:
            of = {self.number[t]: n for t, n in count.items() if frequencies[self.number[t]]}
            terms = np.array(sorted(of, key=lambda t: (-self.weights[t], t)), np.int64)
            item = Item(terms, np.array([of[t] for t in terms.tolist()], np.int64))
            ends = list(zip(terms.tolist(), item.times.tolist(), strict=True))
            item.pairs = np.array([known.setdefault((*a, *b), len(known)) for a, b in zip(ends, ends[1:], strict=False)], np.int64)
            self.items.append(item)
        self.pairs = np.array(list(known), np.int64).reshape(-1, 4)

    def impacts(self, terms: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What a term adds to the score of a document of so many words that holds it so many times."""
        slow = 100 - 25 + 25 * lengths * self.documents // max(1, self.length)
        return self.weights[terms] * (1_000_000_000 * times // (1000 * times + 12 * slow))


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = ENTRIES) -> Iterator[tuple[list, list[Counter[bytes]]]]:
    """The items' ids and term counts, in blocks of bounded size."""
    ids, counts, held = [], [], 0
    for row in keyed(items, id_col, text_col).toLocalIterator():
        found = Counter(words_of(row.text))
        if found:
            ids.append(row.id)
            counts.append(found)
            held += len(found)
        if held >= most:
            yield ids, counts
            ids, counts, held = [], [], 0
    if ids:
        yield ids, counts


def _cuts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _whole(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list with all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def term_blocks(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """A row per block of documents: ids, words and query terms of each document, then all terms and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = number.__contains__
        for part in slices(batches, 1, BLOCK_BYTES):
            lengths, held, terms, times = [], [], [], []
            for text in part.column(1).to_pylist():
                words = words_of(text)
                found = Counter(filter(wanted, words))
                lengths.append(len(words))
                held.append(len(found))
                terms += map(number.__getitem__, found)
                times += found.values()
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays([ids, _whole(np.array(lengths, np.int64), pa.int64()), *(_whole(np.array(x, np.int32), pa.int32()) for x in (held, terms, times))], ["ids", "lengths", "held", "terms", "times"])

    kind = T.ArrayType(docs.schema["id"].dataType)
    fields = [T.StructField("ids", kind), T.StructField("lengths", T.ArrayType(T.LongType())), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("held", "terms", "times"))]
    return docs.mapInArrow(run, T.StructType(fields))


def _numbers(row: pa.RecordBatch, name: str) -> np.ndarray:
    """The list of a block's row as an array."""
    column = row.column(row.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(n, 1) for batch in batches for n in range(batch.num_rows))


def collection_counts(blocks: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Documents of each term, documents with any word, and words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 2, np.int64)
        for row in _rows(batches):
            lengths = _numbers(row, "lengths")
            total[:terms] += np.bincount(_numbers(row, "terms"), minlength=terms)
            total[terms:] += [np.count_nonzero(lengths), lengths.sum()]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    counted = blocks.select("lengths", "terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms + 2, np.int64)
    out[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    return out[:terms], int(out[terms]), int(out[terms + 1])


class Block:
    """The index of one block: impacts by document and by term, and the joint maxima of pairs."""

    def __init__(self, held: np.ndarray, terms: np.ndarray, impacts: np.ndarray, count: int):
        self.size, self.terms, self.impacts = len(held), terms, impacts
        self.cuts = _cuts(held)
        order = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(self.size), held)[order]
        self.values = impacts[order]
        self.lists = _cuts(np.bincount(terms, minlength=count))
        self.maxima = np.zeros(count, np.int64)
        some = np.flatnonzero(np.diff(self.lists))
        if len(some):
            self.maxima[some] = np.maximum.reduceat(self.values, self.lists[some])

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.lists[term], self.lists[term + 1]
        return self.docs[a:b], self.values[a:b]

    def joint_maxima(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair (term, times, term, times) the largest joint impact and its document; 0 and -1 if no document holds both."""
        best, where = np.zeros(len(pairs), np.int64), np.full(len(pairs), -1, np.int32)
        dense = np.zeros(self.size, np.int64)
        order = np.argsort(pairs[:, 2], kind="stable")
        last, docs = -1, np.zeros(0, np.int64)
        for n in order.tolist():
            first, times, second, second_times = pairs[n].tolist()
            if second != last:
                dense[docs] = 0
                docs, values = self.postings(second)
                dense[docs] = values
                last = second
            if not len(docs):
                continue
            own, impacts = self.postings(first)
            other = dense[own]
            both = other > 0
            if both.any():
                joint = np.where(both, times * impacts + second_times * other, 0)
                at = int(joint.argmax())
                best[n], where[n] = joint[at], own[at]
        return best, where

    def scores(self, picked: np.ndarray, item: Item, scratch: np.ndarray) -> np.ndarray:
        """The whole scores of some documents; `scratch` has a zero for every term."""
        scratch[item.terms] = item.times
        sizes = self.cuts[picked + 1] - self.cuts[picked]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.cuts[picked] - (ends - sizes), sizes)
        total = _cuts(scratch[self.terms[at]] * self.impacts[at])
        out = total[ends] - total[ends - sizes]
        scratch[item.terms] = 0
        return out

    def chain_bounds(self, item: Item, joint: np.ndarray) -> np.ndarray:
        """Of every part of the chain from a term to the end: what it can add to a score at most."""
        single = (item.times * self.maxima[item.terms]).tolist()
        pair = np.maximum(joint[item.pairs], np.maximum(single[:-1], single[1:])).tolist() if len(single) > 1 else []
        bounds = [0] * (len(single) + 2)
        for n in range(len(single) - 1, -1, -1):
            bounds[n] = single[n] + bounds[n + 1]
            if n < len(pair):
                bounds[n] = min(bounds[n], pair[n] + bounds[n + 2])
        return np.array(bounds[: len(single) + 1], np.int64)

    def search(self, item: Item, joint: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score is above 0 and not below the limit, and the scores."""
        bounds = self.chain_bounds(item, joint)
        limit = max(limit, 1)
        if bounds[0] < limit:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        needed = int(np.flatnonzero(bounds < limit)[0])  # the last bound, of nothing, is 0
        total = np.zeros(self.size, np.int64)
        for term, times in zip(item.terms[:needed].tolist(), item.times[:needed].tolist(), strict=True):
            docs, values = self.postings(term)
            total[docs] += times * values
        left = np.flatnonzero(total)
        left = left[total[left] + bounds[needed] >= limit]
        for n in range(needed, len(item.terms)):
            if not len(left):
                break
            docs, values = self.postings(int(item.terms[n]))
            if len(docs):
                at = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
                total[left] += np.where(docs[at] == left, item.times[n] * values[at], 0)
            left = left[total[left] + bounds[n + 1] >= limit]
        return left, total[left]


def index_blocks(blocks: DataFrame, queries: Queries) -> DataFrame:
    """The rows of `term_blocks` with impacts in place of counts, and the pairs' joint maxima and their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            held, terms = _numbers(row, "held"), _numbers(row, "terms")
            lengths = np.repeat(_numbers(row, "lengths"), held)
            impacts = queries.impacts(terms, _numbers(row, "times").astype(np.int64), lengths)
            best, where = Block(held, terms, impacts, len(queries.number)).joint_maxima(queries.pairs)
            found = [_whole(held, pa.int32()), _whole(terms, pa.int32()), _whole(impacts, pa.int64()), _whole(best, pa.int64()), _whole(where, pa.int32())]
            yield pa.RecordBatch.from_arrays([row.column(0), *found], ["ids", "held", "terms", "impacts", "joint", "joint_doc"])

    fields = [blocks.schema["ids"], *(T.StructField(n, T.ArrayType(k)) for n, k in (("held", T.IntegerType()), ("terms", T.IntegerType()), ("impacts", T.LongType()), ("joint", T.LongType()), ("joint_doc", T.IntegerType())))]
    return blocks.mapInArrow(run, T.StructType(fields))


def _block_of(row: pa.RecordBatch, terms: int) -> Block:
    return Block(_numbers(row, "held"), _numbers(row, "terms"), _numbers(row, "impacts"), terms)


def limits(index: DataFrame, queries: Queries, top: int) -> np.ndarray:
    """A score for each item that at least `top` documents reach, or 0: from the documents of its pairs' joint maxima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in queries.items]
        scratch = np.zeros(len(queries.number), np.int64)
        for row in _rows(batches):
            block, where = _block_of(row, len(queries.number)), _numbers(row, "joint_doc")
            for n, item in enumerate(queries.items):
                picked = where[item.pairs]
                picked = np.unique(picked[picked >= 0]).astype(np.int64)
                if len(picked):
                    held[n] = np.sort(np.concatenate([held[n], block.scores(picked, item, scratch)]))[-top:]
        items = np.repeat(np.arange(len(held), dtype=np.int32), [len(h) for h in held])
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(np.concatenate([*held, np.zeros(0, np.int64)]))], ["item", "score"])

    found = index.mapInArrow(run, "item int, score long")
    turn = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    last = found.withColumn("turn", turn).where(F.col("turn") == top).select("item", "score").toArrow()
    out = np.zeros(len(queries.items), np.int64)
    out[last.column("item").to_numpy()] = last.column("score").to_numpy()
    return out


def best_documents(index: DataFrame, queries: Queries, least: np.ndarray, top: int) -> DataFrame:
    """(item, id, score): the best documents of every task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in queries.items]
        limit, kind = least.tolist(), None
        for row in _rows(batches):
            kind = row.schema.field(0).type.value_type
            block, joint, ids = _block_of(row, len(queries.number)), _numbers(row, "joint"), row.column(0).flatten()
            for n, item in enumerate(queries.items):
                docs, scores = block.search(item, joint, limit[n])
                if not len(docs):
                    continue
                if len(docs) > top:
                    high = scores >= np.partition(scores, -top)[-top]
                    docs, scores = docs[high], scores[high]
                names = ids.take(pa.array(docs)).to_pylist()
                held[n] = sorted([*held[n], *((-s, name is None, name) for s, name in zip(scores.tolist(), names, strict=True))], key=lambda x: x[:2] if x[1] else x)[:top]
                if len(held[n]) == top:
                    limit[n] = max(limit[n], -held[n][-1][0])
        flat = [(n, name, -s) for n, rows in enumerate(held) for s, _, name in rows]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], kind), pa.array([f[2] for f in flat], pa.int64())], ["item", "id", "score"])

    own = index.schema["ids"].dataType.elementType
    return index.mapInArrow(run, T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", own), T.StructField("score", T.LongType())]))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", top: int = TOP, entries: int = ENTRIES) -> DataFrame:
    """The `top` best documents of every item: item id, rank, document id, score."""
    spark, source = docs.sparkSession, keyed(docs, id_col, text_col)
    item_kind = items.schema[item_id_col].dataType
    parts = [_searched(spark, source, item_kind, ids, counts, top) for ids, counts in item_blocks(items, item_id_col, item_text_col, entries)]
    if not parts:
        fields = [T.StructField("item_id", item_kind), T.StructField("rank", T.IntegerType()), T.StructField("id", source.schema["id"].dataType), T.StructField("score", T.LongType())]
        parts = [spark.createDataFrame([], T.StructType(fields))]
    found = reduce(DataFrame.unionByName, parts)
    return found.select(F.col("item_id").alias(item_id_col), "rank", F.col("id").alias(id_col), "score")


def _searched(spark, source: DataFrame, item_kind: T.DataType, ids: list, counts: list[Counter[bytes]], top: int) -> DataFrame:
    queries = Queries(counts)
    blocks = stored(term_blocks(source, queries.number), "term-blocks")
    queries.weigh(*collection_counts(blocks, len(queries.number)))
    index = stored(index_blocks(blocks, queries), "impact-index")
    found = best_documents(index, queries, limits(index, queries, top), top)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_kind)]))
    # A block's items: a bounded number of rows.
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score")


# The same rows in SQL for an independent engine.
SQL = r"""
WITH letters AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
asked AS (
  SELECT item_id, q, term, count(*) AS times FROM (
    SELECT item_id, q,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT *, row_number() OVER () AS q FROM benchmark)) GROUP BY ALL),
every AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_all FROM letters WHERE len(w) > 0),
held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM letters) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM held WHERE term IN (SELECT term FROM asked) GROUP BY term), every),
slow AS (SELECT r, doc_id, 100 - 25 + (25 * len(w) * n_docs) // n_all AS m FROM letters, every WHERE len(w) > 0),
shares AS (SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS share FROM held JOIN weights USING (term) JOIN slow USING (r)),
scores AS (SELECT q, item_id, r, CAST(sum(times * share) AS BIGINT) AS score FROM asked JOIN shares USING (term) GROUP BY q, item_id, r),
ranked AS (
  SELECT q, item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN slow USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
