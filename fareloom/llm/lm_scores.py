"""Stupid-backoff scores of documents under a bigram model of the same corpus.

    S(w | v) = count(v w) / count(v)             if count(v w) > 0
             = ALPHA * max(count(w), 1) / all words      otherwise

A document is scored by what all others say: its own words and pairs are left out of every count. So a pair that no
other document has backs off to its second word, and a word that no other document has counts as one occurrence. Copies are
documents of their own and do speak for each other. Neither words nor pairs are bounded, and the driver holds none but
a bounded number of the most frequent ones. A document begins with a border, the context of its first word.

Documents meet once (`Meeting`): every task gives the distinct pairs of its documents, with the document's number and own counts, in packed rows, one for
each bundle of documents and bucket, a range of the pair's hash. There are as many buckets as the corpus has million words; a task
reads a few, one after the other, adds up the pairs of each and sends back, per document, what the pairs of two documents or more add to a score. The others
back off. The most frequent words, a bounded number, are held by every task and travel as codes. A pair with another word goes to the bucket of that
word, which counts it, too. A document's score is that of backing off everywhere, plus what its pairs add. `pair_table` is the same model as a
table. Words and pairs are told apart by 64-bit hashes.

Words are separated by white space and not changed. Defined results: null and empty texts have no words, a sum of 0 and no
mean; repeated rows are documents of their own and count as often as they occur; ids may be null; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.common import Words, forget, keyed, mix, slices, stored

ALPHA = 0.4
# The border before the first word, also what its count goes by.
BEGUN = np.uint64(0)
# Half as many as the words of 16 bytes that every task can look up, at most.
FREQUENT = 400_000
# Words for each bucket of pairs, at most on average, and pairs that a task keeps before it deals them out.
BUCKET_WORDS = 1 << 20
# What is shuffled in packed rows are planes of so many bits.
BITS = 8
# Buckets of one task, which are read one after the other; what they add to a document is one answer.
AT_ONCE = 4
# What buckets add to documents is told in such parts of one.
UNITS = 1 << 30
# Words whose pairs with each other are not dealt out by document, at most.
HOT = 1000


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents, words as 64-bit hashes; every task adds up its own counts first.

    The documents that have words are counted as one more word, `BEGUN`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, 1):
            found = Words(part.column(1))
            words, counts = np.unique(found.hashes[0], return_counts=True)
            begun = int(np.sum(np.diff(found.rows) > 0))
            held += [(words, counts), (np.array([BEGUN]), np.array([begun]))]
            size += len(words)
            if size > 1_000_000:
                held = [_added(held)]
                size = len(held[0][0])
                if size > 500_000:
                    yield _counted(*held[0])
                    held, size = [], 0
        if held:
            yield _counted(*_added(held))

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
    return words, np.bincount(at, np.concatenate([c for _, c in held]), len(words)).astype(np.int64)


def _counted(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])


class Frequent:
    """The most frequent entries of a table with a column `n`, no more than `most`, as arrays sorted by their key."""

    def __init__(self, table: DataFrame, key: str, values: tuple[str, ...], most: int):
        sizes = table.groupBy("n").agg(F.count("*").alias("entries")).orderBy(F.desc("n")).limit(most).collect()
        taken, least = 0, None
        for row in sizes:
            taken += row.entries
            if taken > most:
                break
            least = row.n
        self.least = least
        held = table.where(self._holds()).select(key, *values).toArrow()
        keys = held.column(key).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [held.column(v).to_numpy()[order] for v in values]

    def _holds(self) -> Column:
        return F.col("n") >= self.least if self.least is not None else F.lit(False)

    def others(self, table: DataFrame) -> DataFrame:
        """The entries of the table that are not held."""
        return table.where(~self._holds())

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are held, and where."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


def _ranks(values: np.ndarray) -> np.ndarray:
    """The place of each value among the different ones, from 1."""
    order = np.argsort(values)
    new = np.ones(len(order), bool)
    new[1:] = np.diff(values[order]) != 0
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class TextPairs:
    """The distinct words of some documents and their distinct pairs, with the documents' own counts."""

    def __init__(self, column: pa.Array):
        words = Words(column)
        self.rows, self.count = words.rows, len(column)
        second = words.hashes[0]
        owner = np.repeat(np.arange(self.count), np.diff(self.rows))
        # Every document's distinct words are numbered; a pair is two of these numbers.
        rank = _ranks(second)
        key = owner << 32 | rank
        order = np.argsort(key)
        new = np.ones(len(order), bool)
        new[1:] = np.diff(key[order]) != 0
        self.word_at = order[new]
        self.word_owner, self.words = owner[self.word_at], second[self.word_at]
        self.word_n = np.diff(np.append(np.flatnonzero(new), len(order)))
        first = np.empty_like(second)
        first[1:] = second[:-1]
        begins = self.rows[:-1][self.rows[:-1] < self.rows[1:]]
        first[begins] = BEGUN
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        before = np.empty_like(number)
        before[1:] = number[:-1]
        before[begins] = -1
        key = number << 32 | before + 1
        order = np.argsort(key)
        new = np.ones(len(order), bool)
        new[1:] = np.diff(key[order]) != 0
        at = order[new]
        self.first, self.second, self.owner = first[at], second[at], owner[at]
        # The words' ranks in one number, which sorts as the two hashes do.
        ahead = np.empty_like(rank)
        ahead[1:] = rank[:-1]
        ahead[begins] = 0
        self.place = ahead[at] << 32 | rank[at]
        self.n = np.diff(np.append(np.flatnonzero(new), len(order)))
        # Where its words stand among the documents' distinct words; the border is at -1.
        self.first_at, self.second_at = before[at], number[at]
        self.own_second = self.word_n[number[at]]
        # A document has one border, and its last word is the context of nothing but is counted as a word all the same.
        self.own_first = np.where(before[at] < 0, 1, self.word_n[before[at]])

    def sums(self, owner: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, self.count).astype(np.float64)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first + np.uint64(0x9E3779B97F4A7C15)) + second)


def slice_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, n, documents): each pair of some documents once, how often and in how many of them it occurs."""
    own = TextPairs(column)
    order = np.argsort(own.place)  # sorted, they are smaller when they are shuffled
    new = np.ones(len(order), bool)
    new[1:] = np.diff(own.place[order]) != 0
    at = np.flatnonzero(new)
    n = np.add.reduceat(own.n[order], at) if len(at) else own.n
    return own.first[order[at]], own.second[order[at]], n, np.diff(np.append(at, len(order)))


def _dealt(held: list[tuple[np.ndarray, ...]], shift: int) -> pa.RecordBatch:
    """A row per bucket: the pairs of some slices in it, each once, as 64-bit numbers, and the counts of each as 32-bit numbers."""
    first, second, n, documents = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
    # They come in the order of their hash, whose first bits are the bucket.
    bucket = (pair_hash(first, second) >> np.uint64(shift) >> np.uint64(1)).astype(np.int32)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*at[1:].tolist(), len(bucket)]
    columns = (np.stack([first, second]), np.stack([n, documents]).astype(np.int32))
    packed = [pa.array([x[:, a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=True)], pa.binary()) for x in columns]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), *packed], ["bucket", "pairs", "counts"])


def _merged(first: np.ndarray, second: np.ndarray, n: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, with the sums of its counts, in the order of its hash."""
    hashes = pair_hash(first, second)
    order = np.argsort(hashes)
    hashes = hashes[order]
    at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(order) else order
    sums = (np.add.reduceat(x[order].astype(np.int64), at) if len(at) else x.astype(np.int64) for x in (n, documents))
    return first[order[at]], second[order[at]], *sums


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes before all second ones: neighbours are alike, so they are smaller when they are shuffled."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _from_planes(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _added_up(key: np.ndarray, n: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, in order, with the sums of its counts."""
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
    sums = (np.add.reduceat(x[order], at, dtype=np.int64) if len(at) else x.astype(np.int64) for x in (n, documents))
    return key[at], *sums


def _dealt_codes(held: list[tuple[np.ndarray, ...]], shift: int) -> pa.RecordBatch:
    """A row per bucket: the pairs of two held words in it, each once, as two 32-bit codes in one number, and their counts."""
    key, n, documents = _added_up(*(np.concatenate(x) for x in zip(*held, strict=True)))
    bucket = (mix(key) >> np.uint64(shift) >> np.uint64(1)).astype(np.int32)
    order = np.argsort(bucket.astype(np.uint16) if shift >= 47 else bucket, kind="stable")
    bucket, key, n, documents = bucket[order], key[order], n[order].astype(np.int32), documents[order].astype(np.int32)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    parts = list(zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True))
    pairs = pa.array([_planes(key[a:b]) for a, b in parts], pa.binary())
    counts = pa.array([_planes(np.concatenate([n[a:b], documents[a:b]])) for a, b in parts], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pairs, counts, pa.array(np.ones(len(at), bool))], ["bucket", "pairs", "counts", "coded"])


def pair_table(texts: DataFrame, counts: DataFrame, total: int, words: Frequent, begun: int) -> DataFrame:
    """(pair, n, first_n, second_n): the pairs of two documents or more and how often they and their words occur.

    Words that are held have a code, their place among them, and the border has the code 0; pairs of two such words travel as codes and find the
    counts of their words at once. If all words that occur twice are held, no other pair can be in two documents.
    """
    bits = max(0, math.ceil(math.log2(max(total, 1) / BUCKET_WORDS)))
    shift, complete = 63 - bits, words.least is not None and words.least <= 2

    def codes(keys: np.ndarray) -> np.ndarray:
        held, at = words.find(keys)
        return np.where(keys == BEGUN, 0, np.where(held, at + 1, -1))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, others, size = [], [], 0
        for part in slices(batches, 1, 1 << 20):
            first, second, n, documents = slice_pairs(part.column(1))
            a, b = codes(first), codes(second)
            both = (a >= 0) & (b >= 0)
            held.append(((a[both] << 32 | b[both]).astype(np.uint64), n[both].astype(np.int32), documents[both].astype(np.int32)))
            size += len(held[-1][0])
            if not complete:
                others.append(tuple(x[~both] for x in (first, second, n, documents)))
                size += len(others[-1][0])
            if size > BUCKET_WORDS:
                yield from dealt(held, others)
                held, others, size = [], [], 0
        if size:
            yield from dealt(held, others)

    def dealt(held: list[tuple[np.ndarray, ...]], others: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if any(len(x[0]) for x in held):
            yield _dealt_codes(held, shift)
        if any(len(x[0]) for x in others):
            rows = _dealt(others, shift)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.zeros(rows.num_rows, bool))], ["bucket", "pairs", "counts", "coded"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition is one bucket."""
        keys, sums, pairs, numbers = [], [], [], []
        for batch in batches:
            for pair, count, coded in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if coded:
                    keys.append(_from_planes(pair, np.uint64))
                    sums.append(_from_planes(count, np.int32).reshape(2, -1))
                else:
                    pairs.append(np.frombuffer(pair, np.uint64).reshape(2, -1))
                    numbers.append(np.frombuffer(count, np.int32).reshape(2, -1))
        if keys:
            key, n, documents = _added_up(np.concatenate(keys), *np.concatenate(sums, axis=1))
            key, n = key[documents > 1], n[documents > 1]
            sides = [(key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            names, times = np.append(BEGUN, words.keys), np.append(begun, words.values[0])
            empty = pa.nulls(len(key), pa.int64())
            pair = pair_hash(*(names[side] for side in sides))
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), empty, empty, *map(pa.array, (n, *(times[side] for side in sides)))], columns)
        if pairs:
            first, second, n, documents = _merged(*np.concatenate(pairs, axis=1), *np.concatenate(numbers, axis=1))
            first, second, n = (x[documents > 1] for x in (first, second, n))
            empty = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (pair_hash(first, second), first, second)), pa.array(n), empty, empty], columns)

    columns = ["pair", "first", "second", "n", "first_n", "second_n"]
    every = texts.mapInArrow(found, "bucket int, pairs binary, counts binary, coded boolean").repartitionById(1 << bits, F.col("bucket"))
    table = stored(every.mapInArrow(shared, ", ".join(f"{c} long" for c in columns)), "shared-pairs")
    whole = table.where("first_n IS NOT NULL").select("pair", "n", "first_n", "second_n")
    if complete:
        return whole
    of = lambda side: counts.select(F.col("word").alias(side), F.col("n").alias(f"{side}_n"))
    rest = table.where("first_n IS NULL").select("pair", "first", "second", "n")
    first = stored(rest.join(of("first"), "first"), "first-counts")
    both = stored(first.join(of("second"), "second").select("pair", "n", "first_n", "second_n"), "pairs")
    forget(first)
    return whole.unionByName(both)


def _pack(bits: int, *columns: np.ndarray) -> bytes:
    """Columns of one length, numbers from 0 or 64-bit fractions, as compressed planes of `bits` bits, as many as the largest value of each needs."""
    columns = [x.view(np.uint64) if x.dtype == np.float64 else x.astype(np.uint64) for x in columns]
    counts = [-(-int(x.max(initial=0)).bit_length() // bits) for x in columns]
    mask = np.uint64((1 << bits) - 1)
    planes = [(x >> np.uint64(bits * place) & mask).astype(np.uint8) for x, count in zip(columns, counts, strict=True) for place in range(count)]
    head = np.array([bits, len(columns), len(columns[0]), *counts], np.int32).tobytes()
    return head + pa.compress(b"".join(p.tobytes() for p in planes), "zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    """The columns that `_pack` was given, as unsigned numbers."""
    bits, width, size = np.frombuffer(data, np.int32, 3).tolist()
    counts = np.frombuffer(data, np.int32, width, 12).tolist()
    planes = np.frombuffer(pa.decompress(data[12 + 4 * width :], size * sum(counts), "zstd", asbytes=True), np.uint8).reshape(sum(counts), size)
    out, at = [], 0
    for count in counts:
        out.append(np.zeros(size, np.uint64))
        for place in range(count):
            out[-1] |= planes[at + place].astype(np.uint64) << np.uint64(bits * place)
        at += count
    return out


_FACTOR = 0x9E3779B97F4A7C15


def _spread(keys: np.ndarray, half: int) -> np.ndarray:
    """Numbers of 2 * `half` bits one to one into such numbers whose first bits depend on all bits."""
    mask, factor = np.uint64((1 << 2 * half) - 1), np.uint64(_FACTOR)
    keys = keys * factor & mask
    return (keys ^ keys >> np.uint64(half)) * factor & mask


def _gathered(keys: np.ndarray, half: int) -> np.ndarray:
    """What `_spread` was given."""
    mask, factor = np.uint64((1 << 2 * half) - 1), np.uint64(pow(_FACTOR, -1, 1 << 2 * half))
    keys = keys * factor & mask
    return (keys ^ keys >> np.uint64(half)) * factor & mask


class Meeting:
    """How the pairs of all documents meet once, dealt out to buckets in packed rows.

    A task numbers its documents in bundles. Pairs travel with the document's number and its own counts, sorted by document: those of two held
    words as one number made of the words' codes, to the bucket of that number; others to the bucket of a word that is not held, where that word of all
    documents is counted too. So a bucket knows the counts of all words but the first of two that are not held. The words of which a bucket may not hold all
    pairs (`HOT` at most, the border among them) are hot: the pairs of two of them stay with their bundle, and only what a bundle's
    documents have of them together travels. What a bucket adds to a document is sent back in units of 2**-30.
    """

    # Documents of a bundle; pairs of held words; pairs whose first, second or both words are not held; these words; pairs of hot words; sums of these;
    # answers to documents; words to be joined to their counts; sums of these.
    READY, CODED, FIRST, SECOND, BOTH, WORD, HOT_PAIRS, HOT_SUMS, ANSWER, TAKEN, JOINED = range(11)

    def __init__(self, words: Frequent, total: int, begun: int):
        self.words = words
        self.complete = words.least is not None and words.least <= 2
        self.buckets = max(1, -(-total // BUCKET_WORDS))
        # By their code, which is 0 for the border.
        self.times = np.append(begun, words.values[0]).astype(np.int64)
        self.half = max(1, len(words.keys).bit_length())
        # The first bits of a pair's number that its bucket goes by, and those after them.
        self.lead = min(32, 2 * self.half)
        self.rest = 2 * self.half - self.lead
        self.hot = self.times >= BUCKET_WORDS
        if np.count_nonzero(self.hot) > HOT:
            self.hot[np.argsort(-self.times, kind="stable")[HOT:]] = False
        self.size, self.plane = BUCKET_WORDS, BITS

    def codes(self, keys: np.ndarray) -> np.ndarray:
        held, at = self.words.find(keys)
        return np.where(keys == BEGUN, 0, np.where(held, at + 1, -1))

    def _bucket(self, first_bits: np.ndarray, bits: int = 32) -> np.ndarray:
        return first_bits * np.uint64(self.buckets) >> np.uint64(bits)

    def _least(self, bucket: np.ndarray) -> np.ndarray:
        """The smallest number of a bucket of pairs of held words."""
        return -(-(bucket.astype(np.int64) << self.lead) // self.buckets).astype(np.uint64) << np.uint64(self.rest)

    def deal(self, texts: DataFrame) -> DataFrame:
        return texts.mapInArrow(self._found, "bucket int, kind int, bundle long, data binary").repartitionById(-(-self.buckets // AT_ONCE), F.floor(F.col("bucket") / AT_ONCE).cast("int"))

    def _found(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size, docs, held = TaskContext.get().partitionId(), 0, 0, 0, defaultdict(list)
        for part in slices(batches, 1, 1 << 20):
            own = TextPairs(part.column(1))
            code = self.codes(own.words)
            known = code >= 0
            others = np.maximum(self.times[code[known]] - own.word_n[known], 1)
            value = own.sums(own.word_owner[known], own.word_n[known] * np.log(others))
            held[self.READY].append((part.column(0).to_numpy().view(np.uint64), np.diff(own.rows), value))
            first, second = np.append(code, 0)[own.first_at], code[own.second_at]
            counts = [x.astype(np.int32) for x in (own.owner + docs, own.n, own.own_first, own.own_second)]
            both = (first >= 0) & (second >= 0)
            key = (np.where(both, first, 0) << self.half | np.where(both, second, 0)).astype(np.uint64)
            hot = both & self.hot[first] & self.hot[second]
            for kind, which in ((self.HOT_PAIRS, hot), (self.CODED, both & ~hot)):
                held[kind].append((key[which], *(x[which] for x in counts)))
            # If all words that occur twice are held, no other word or pair is in two documents.
            if not self.complete:
                doc, n, own_first, own_second = counts
                one, other = (first < 0) & (second >= 0), second < 0
                held[self.FIRST].append([x[one] for x in (own.first, second, doc, n, own_first, own_second)])
                for kind, which, firsts in ((self.SECOND, other & (first >= 0), first), (self.BOTH, other & (first < 0), own.first)):
                    held[kind].append([x[which] for x in (own.second, firsts, doc, n, own_second, own_first)])
                held[self.WORD].append([x[~known] for x in (own.words, (own.word_owner + docs).astype(np.int32), own.word_n.astype(np.int32))])
            docs += own.count
            size += len(own.n)
            if size > self.size:
                yield self._dealt(task, number, held)
                number, size, docs, held = number + 1, 0, 0, defaultdict(list)
        if docs:
            yield self._dealt(task, number, held)

    def _dealt(self, task: int, number: int, held: dict[int, list[tuple[np.ndarray, ...]]]) -> pa.RecordBatch:
        """The rows of a bundle. Its name goes by its rows in their order, so that no other rows can take its place if a task is run again."""
        whole = {kind: [np.concatenate(x) for x in zip(*held.pop(kind), strict=True)] for kind in list(held)}
        names = whole[self.READY][0]
        told = np.sum(mix(names + np.arange(len(names), dtype=np.uint64)), dtype=np.uint64) + np.uint64(task << 32 | number)
        bundle = mix(np.array([told])) >> np.uint64(1)
        here, rows = int(self._bucket(bundle >> np.uint64(31))[0]), []
        for kind in (self.READY, self.HOT_PAIRS):
            if len(whole[kind][0]):
                rows.append((here, kind, _pack(self.plane, *whole[kind])))
        if len(whole[self.HOT_PAIRS][0]):
            key, _, n, _, _ = whole.pop(self.HOT_PAIRS)
            key, n, documents = _added_up(key, n, np.ones(len(n), np.int64))
            rows += self._by_bucket(self.HOT_SUMS, self._bucket(_spread(key, self.half) >> np.uint64(self.rest), self.lead), key, n, documents)
        key, *counts = whole.pop(self.CODED)
        key = _spread(key, self.half)
        bucket = self._bucket(key >> np.uint64(self.rest), self.lead)
        rows += self._by_bucket(self.CODED, bucket, key - self._least(bucket), *counts, doc=1)
        for kind, doc in ((self.FIRST, 2), (self.SECOND, 2), (self.BOTH, 2), (self.WORD, 1)):
            if kind in whole:
                columns = whole.pop(kind)
                rows += self._by_bucket(kind, self._bucket(columns[0] >> np.uint64(32)), *columns, doc=doc)
        bundle = int(bundle[0])
        buckets, kinds, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array([bundle] * len(rows), pa.int64()), pa.array(data, pa.binary())], ["bucket", "kind", "bundle", "data"])

    def _by_bucket(self, kind: int, bucket: np.ndarray, *columns: np.ndarray, doc: int | None = None) -> Iterator[tuple[int, int, bytes]]:
        """A row per bucket. Documents, in order, are told by their differences."""
        bucket = bucket.astype(np.uint16 if self.buckets <= 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [x[order] for x in columns]
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else bucket
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True) if len(bucket) else ():
            cut = [x[a:b] for x in columns]
            if doc is not None:
                cut[doc] = np.diff(cut[doc], prepend=0)
            yield int(bucket[a]), kind, _pack(self.plane, *cut)

    def meet(self, dealt: DataFrame) -> DataFrame:
        """(kind, bundle, data): what the pairs that two documents or more have add to each document. A partition is `AT_ONCE` buckets."""
        return dealt.mapInArrow(self._met, "kind int, bundle long, data binary")

    def _met(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, place, answers = defaultdict(lambda: defaultdict(list)), {}, []
        for batch in batches:
            passed = []
            for bucket, kind, bundle, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind in (self.READY, self.HOT_PAIRS):
                    passed.append((kind, bundle, data))
                else:
                    whole[bucket][kind].append((place.setdefault(bundle, len(place)), data))
            if passed:
                yield self._rows(passed)
        bundles = list(place)
        for bucket in list(whole):
            added, rows = self._bucket_sums(bucket, whole.pop(bucket), bundles)
            if rows:
                yield self._rows(rows)
            answers = [self._summed(*(np.concatenate(x) for x in zip(*answers, *added, strict=True)))] if added else answers
        if answers and len(answers[0][0]):
            yield self._answers(bundles, *answers[0])

    def _bucket_sums(self, bucket: int, held: dict[int, list[tuple[int, bytes]]], bundles: list[int]) -> tuple[list[tuple[np.ndarray, ...]], list[tuple[int, int, bytes]]]:
        """What a bucket adds to documents, each told by its bundle and its number there, and rows of other kinds."""
        answers, rows = [], []
        if held[self.HOT_SUMS]:
            parts = [_unpack(data) for _, data in held.pop(self.HOT_SUMS)]
            key, n, documents = _added_up(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            rows.append((self.HOT_SUMS, 0, _pack(self.plane, key[documents > 1], n[documents > 1])))
        if held[self.CODED]:
            which, (key, doc, *counts) = self._together(held.pop(self.CODED), 1)
            seen, others = self._others(key, counts[0])
            key = _gathered(key[seen] + self._least(np.array([bucket])), self.half)
            sides = [(key >> np.uint64(self.half)).astype(np.int64), (key & np.uint64((1 << self.half) - 1)).astype(np.int64)]
            n, own_first, own_second = (x[seen] for x in counts)
            value = self.gained(n, others, *(self.times[side] for side in sides), own_first, own_second)
            answers.append((which[seen] << 32 | doc[seen], n, value))
            del which, key, doc, counts, seen, others, sides, n, own_first, own_second, value
        if held[self.WORD]:
            which, (word, doc, own) = self._together(held.pop(self.WORD), 1)
            words, at = np.unique(word, return_inverse=True)
            times = np.bincount(at, own).astype(np.int64)
            others = times[at] - own
            more = others > 1
            answers.append((which[more] << 32 | doc[more], np.zeros(np.count_nonzero(more), np.int32), own[more] * np.log(others[more])))
        names = np.append(BEGUN, self.words.keys)
        for kind in (self.FIRST, self.SECOND, self.BOTH):
            if not held[kind]:
                continue
            which, (word, other, doc, *counts) = self._together(held.pop(kind), 2)
            name = other if kind == self.BOTH else names[other.astype(np.int64)]
            seen, others = self._others(pair_hash(word, name) if kind == self.FIRST else pair_hash(name, word), counts[0])
            which, word, other, doc, n, own, other_own = (x[seen] for x in (which, word, other, doc, *counts))
            value = n * (np.log(others) - np.log(np.maximum(times[np.searchsorted(words, word)] - own, 1)))
            if kind == self.BOTH:
                rows += [(self.TAKEN, bundles[at], _pack(self.plane, *(x[a:b] for x in (other, doc, other_own, n)))) for at, a, b in self._cuts(which)]
            else:
                value -= n * np.log(np.maximum(self.times[other.astype(np.int64)] - other_own, 1))
            answers.append((which << 32 | doc, n, value))
        return answers, rows

    @staticmethod
    def gained(n: np.ndarray, others: np.ndarray, first_n: np.ndarray, second_n: np.ndarray, own_first: np.ndarray, own_second: np.ndarray) -> np.ndarray:
        """What pairs add to a document beside backing off."""
        return n * (np.log(others) - np.log(first_n - own_first) - np.log(np.maximum(second_n - own_second, 1)))

    @staticmethod
    def _together(held: list[tuple[int, bytes]], doc: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The place of each entry's bundle, and the entries' columns."""
        places, columns = [place for place, _ in held], []
        for at, (_, data) in enumerate(held):
            found = _unpack(data)
            found[doc] = np.cumsum(found[doc])
            columns.append([*found[:doc], *(x.astype(np.int32) for x in found[doc:])])
            held[at] = None
        which = np.repeat(np.array(places, np.int64), [len(x[0]) for x in columns])
        return which, [np.concatenate(x) for x in zip(*columns, strict=True)]

    @staticmethod
    def _others(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries whose key others have too, and how often the others have it. A document has a key once."""
        order = np.argsort(key)
        new = np.append(True, key[order[1:]] != key[order[:-1]])
        at = np.flatnonzero(new)
        documents, total = np.diff(np.append(at, len(order))), np.add.reduceat(n[order], at, dtype=np.int64)
        found = np.empty(len(order), np.int64)
        found[order] = np.repeat(np.where(documents > 1, total, 0), documents)
        seen = np.flatnonzero(found)
        return seen, found[seen] - n[seen]

    @staticmethod
    def _cuts(which: np.ndarray) -> list[tuple[int, int, int]]:
        """Each run of equal numbers: the number, where it begins and ends."""
        at = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else which
        return list(zip(which[at].tolist(), at.tolist(), [*at[1:].tolist(), len(which)], strict=True)) if len(which) else []

    @staticmethod
    def _summed(slot: np.ndarray, n: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each document once, in order."""
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        at = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else order
        return (slot[at], np.add.reduceat(n[order], at, dtype=np.int64), np.add.reduceat(value[order], at)) if len(at) else (slot, n, value)

    def _answers(self, bundles: list[int], slot: np.ndarray, n: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        """A row per bundle, with the sums of its documents that have any."""
        doc, value = slot & 0xFFFFFFFF, np.rint(value * UNITS).astype(np.int64)
        # The sign is the last bit, so that small numbers have few planes.
        value = np.abs(value) << 1 | (value < 0)
        return self._rows([(self.ANSWER, bundles[which], _pack(self.plane, np.diff(doc[a:b], prepend=0), n[a:b], value[a:b])) for which, a, b in self._cuts(slot >> 32)])

    @staticmethod
    def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        kinds, bundles, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(bundles, pa.int64()), pa.array(data, pa.binary())], ["kind", "bundle", "data"])

    def joined(self, met: DataFrame, counts: DataFrame) -> DataFrame:
        """(bundle, doc, value): what the counts of the first of two words that are not held take off documents."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bundle, data in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                    word, doc, own, n = (x.view(np.int64) for x in _unpack(data))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (word, np.full(len(word), bundle), doc, own, -n)], ["word", "bundle", "doc", "own", "weight"])

        asked = met.where(F.col("kind") == self.TAKEN).mapInArrow(run, "word long, bundle long, doc long, own long, weight long")
        # Words that occur once are in no other document, and are not looked for.
        found = asked.join(self.words.others(counts.where("word <> 0 AND n > 1")), "word")
        return found.groupBy("bundle", "doc").agg(F.sum(F.col("weight") * F.log(F.greatest(F.col("n") - F.col("own"), F.lit(1)))).alias("value"))

    def sums(self, met: DataFrame, counts: DataFrame) -> DataFrame:
        """(row, n_words, pair_n, value) of each document."""
        keys, totals = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if self.hot.any():
            told = [_unpack(r.data) for r in met.where(F.col("kind") == self.HOT_SUMS).select("data").collect()]
            if told:
                keys, totals = (np.concatenate(x) for x in zip(*told, strict=True))
                order = np.argsort(keys)
                keys, totals = keys[order], totals[order].astype(np.int64)

        def hot(data: bytes) -> tuple[np.ndarray, ...]:
            key, doc, *counts = _unpack(data)
            at = np.searchsorted(keys, key)
            seen = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == key) if len(keys) else np.zeros(0, np.int64)
            n, own_first, own_second = (x[seen].astype(np.int64) for x in counts)
            first, second = (self.times[side.astype(np.int64)] for side in (key[seen] >> np.uint64(self.half), key[seen] & np.uint64((1 << self.half) - 1)))
            return doc[seen], n, self.gained(n, totals[at[seen]] - n, first, second, own_first, own_second)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready, sums = {}, defaultdict(lambda: np.zeros((2, 0)))

            def add(bundle: int, doc: np.ndarray, n: np.ndarray, value: np.ndarray) -> None:
                doc = doc.astype(np.int64)
                size, has = int(doc.max(initial=-1)) + 1, sums[bundle].shape[1]
                if size > has:
                    sums[bundle] = np.pad(sums[bundle], ((0, 0), (0, max(size, 2 * has) - has)))
                for of, x in zip(sums[bundle], (n, value), strict=True):
                    np.add.at(of, doc, x)

            for batch in batches:
                kinds = batch.column(0).to_numpy()
                packed = batch.filter(pa.array(kinds != self.JOINED))
                for kind, bundle, data in zip(*(packed.column(k).to_pylist() for k in range(3)), strict=True):
                    if kind == self.READY:
                        ready[bundle] = _unpack(data)
                    elif kind == self.HOT_PAIRS:
                        add(bundle, *hot(data))
                    else:
                        doc, n, value = _unpack(data)
                        value = value.astype(np.int64)
                        add(bundle, np.cumsum(doc), n.astype(np.int64), np.where(value & 1, -(value >> 1), value >> 1) / UNITS)
                words = batch.filter(pa.array(kinds == self.JOINED))
                bundle, doc, value = (words.column(k).to_numpy() for k in (1, 3, 4))
                for name in np.unique(bundle).tolist():
                    mine = bundle == name
                    add(name, doc[mine], np.zeros(np.count_nonzero(mine)), value[mine])
            if sums.keys() - ready.keys():
                raise RuntimeError("a task that was run again read its rows in another order; store the documents before they are scored")
            for bundle, (row, n_words, value) in ready.items():
                n, more = np.pad(sums[bundle], ((0, 0), (0, max(0, len(row) - sums[bundle].shape[1]))))[:, : len(row)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row.view(np.int64), n_words.view(np.int64), n.astype(np.int64), value.view(np.float64) + more)], ["row", "n_words", "pair_n", "value"])

        none = F.lit(None)
        every = met.where(F.col("kind").isin(self.READY, self.HOT_PAIRS, self.ANSWER)).select("kind", "bundle", "data", none.cast("long").alias("doc"), none.cast("double").alias("value"))
        if not self.complete:
            words = self.joined(met, counts).select(F.lit(self.JOINED).alias("kind"), "bundle", none.cast("binary").alias("data"), "doc", "value")
            every = every.unionByName(words)
        return every.repartition("bundle").mapInArrow(run, "row long, n_words long, pair_n long, value double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """One row per document: id, n_words, log_score (natural logarithm, summed over the words) and mean_log_score."""
    source = keyed(docs, id_col, text_col).select(F.xxhash64("id", "text").alias("row"), "text", "id")
    texts = source.select("row", "text")
    counts = stored(word_counts(texts), "words")
    total, begun = counts.agg(F.sum(F.when(F.col("word") != 0, F.col("n"))), F.sum(F.when(F.col("word") == 0, F.col("n")))).first()
    words = Frequent(counts.where("word <> 0"), "word", ("n",), 2 * FREQUENT)
    total = total or 0
    meeting = Meeting(words, total, begun or 0)
    met = stored(meeting.meet(meeting.deal(texts)), "pair-sums")
    # Repeated rows have one name.
    added = meeting.sums(met, counts).groupBy("row").agg(*(F.sum(n).alias(n) for n in ("n_words", "pair_n", "value")))
    sums = stored(added, "document-sums")
    forget(met)
    rows = source.select("id", "row")
    copies = rows.groupBy("row").agg(F.count("*").alias("copies"))
    # Repeated rows were added up under one name.
    one = [(F.col(n) / F.col("copies")).alias(n) for n in ("n_words", "pair_n", "value")]
    each = sums.join(copies, "row").select("row", *one)
    backed = math.log(alpha) - F.log(F.greatest(F.lit(total) - F.col("n_words"), F.lit(1.0)))
    log_score = F.col("value") + (F.col("n_words") - F.col("pair_n")) * backed
    each = each.where("n_words > 0").select("row", F.col("n_words").cast("long").alias("n_words"), log_score.alias("log_score"))
    return rows.join(each, "row", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.round(F.coalesce("log_score", F.lit(0.0)), 6).alias("log_score"),
        F.round(F.col("log_score") / F.col("n_words"), 9).alias("mean_log_score"),
    )
