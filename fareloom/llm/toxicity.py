"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its byte n-grams, with its borders; n-grams share hashed embedding rows, so a misspelling shares
most of its vector with the word it stands for. A word's vector is the mean of its n-grams', a document's vector
the mean of its words'; two class weights and biases sit on top. Embeddings and weights are learned together with
Adam on the weighted log loss of a bounded sample of labelled rows: at most `SAMPLE` rows of each label, those whose id
has the smallest hash, weighted back to the shares that all usable labels have.

At scoring time the linear layer is folded into one number per embedding row, so a document's logit is a mean
of means over its n-grams. Every text is scored whole.

Defined results: null and empty texts have the score of a text without words; ids may be null or repeated; label rows
without a label or whose document is missing are not used; without labels of both kinds the score is the smoothed share
of toxic labels (0 if there are none); other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.llm.common import keyed, slices

SAMPLE = 1_500
BUCKETS = 1 << 16
DIMENSIONS = 4
PASSAGE = 2
LEAST_TEXTS = 3
GRAMS = (3, 4, 5, 6)
ROUNDS = 80
RATE = 0.05
SMOOTH = 1e-5
THRESHOLD = 0.3

_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(128, 256))
_FOLD = bytes(b if b in _LETTERS else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(_FOLD)


class Grams:
    """The words of folded texts, and the bucket of the n-gram that begins at each byte.

    A word's n-grams may take in one blank before and one after it.
    """

    def __init__(self, texts: list[bytes], buckets: int = BUCKETS):
        self.raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self.shift = np.uint64(64 - (buckets.bit_length() - 1))
        inside = self.raw != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        self.rows = np.searchsorted(self.starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: buckets by first byte, and per word the first byte and the end of its n-grams' beginnings."""
        hashes = self.raw.astype(np.uint64)
        for n in range(2, max(GRAMS) + 1):
            count = len(self.raw) - n + 1
            if count <= 0:
                return
            hashes = hashes[:count] * np.uint64(0x100000001B3) + self.raw[n - 1 :]
            if n in GRAMS:
                begin = np.minimum(self.starts - 1, count)
                cells = ((hashes + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
                yield cells.astype(np.intp), begin, np.clip(self.ends + 2 - n, begin, max(count, 0))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, bucket) of every n-gram."""
        words, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for cells, begin, end in self.cells():
            sizes = end - begin
            own = np.repeat(np.arange(len(begin)), sizes)
            words.append(own)
            found.append(cells[np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[own]])
        return np.concatenate(words), np.concatenate(found)

    def word_means(self, values: np.ndarray) -> np.ndarray:
        """The mean of a value per bucket over each word's n-grams; 0 for words without any."""
        total, count = np.zeros(len(self.starts)), np.zeros(len(self.starts), np.int64)
        for cells, begin, end in self.cells():
            sums = np.concatenate([[0.0], np.cumsum(values[cells])])
            total += sums[end] - sums[begin]
            count += end - begin
        return total / np.maximum(count, 1)


class Bag:
    """A sparse matrix with both directions sorted for sums by row or by column."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, shape: tuple[int, int]):
        self.sides = []
        for own, other, size in ((rows, columns, shape[0]), (columns, rows, shape[1])):
            order = np.argsort(own, kind="stable")
            key = own[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            self.sides.append((other[order], weights[order, None].astype(np.float32), starts, key[starts], size))

    def dot(self, dense: np.ndarray, transposed: bool = False) -> np.ndarray:
        other, weights, starts, keys, size = self.sides[transposed]
        out = np.zeros((size, dense.shape[1]), np.float32)
        if len(starts):
            for column in range(dense.shape[1]):
                out[keys, column] = np.add.reduceat(dense[other, column] * weights[:, 0], starts)
        return out


def passages(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each passage, and the passages of each text: `PASSAGE` words each, the last one shorter."""
    counts = -(-np.diff(rows) // PASSAGE)
    ends = np.concatenate([[0], np.cumsum(counts)])
    inside = np.arange(ends[-1]) - np.repeat(ends[:-1], counts)
    return np.repeat(rows[:-1], counts) + PASSAGE * inside, ends


@dataclass
class Model:
    """What scoring needs: one number per bucket, the bias, and how the passages of a text make its score."""

    values: np.ndarray
    bias: float
    scale: tuple[float, ...]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: 1, the highest logit of a passage, and the logarithms of the passages and of the toxic ones."""
        grams = Grams([folded(t) for t in texts], len(self.values))
        starts, ends = passages(grams.rows)
        count = np.diff(ends)
        out = np.stack([np.ones(len(texts)), np.zeros(len(texts)), np.log1p(count), np.zeros(len(texts))], 1)
        if len(starts):
            means = np.add.reduceat(grams.word_means(self.values), starts) / np.diff(np.append(starts, grams.rows[-1]))
            some, logits = count > 0, means + self.bias
            out[some, 1] = np.maximum.reduceat(logits, ends[:-1][some])
            out[some, 3] = np.log1p(np.add.reduceat(logits > 0, ends[:-1][some], dtype=np.int64))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.scale), -30, 30)))


def _embed(rows: list[list[bytes]], labels: np.ndarray, weights: np.ndarray, buckets: int, rounds: int) -> tuple[np.ndarray, float]:
    """Embeddings and linear softmax, learned jointly on passages with the labels of their texts, folded per bucket."""
    seen = Counter(chain.from_iterable(map(set, rows)))
    number = {w: n for n, w in enumerate(sorted(w for w, n in seen.items() if n >= LEAST_TEXTS))}
    starts, ends = passages(np.cumsum([0, *map(len, rows)]))
    total = sum(map(len, rows))
    words = np.fromiter((number.get(w, -1) for w in chain.from_iterable(rows)), np.int64, total)
    own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, total)))
    sizes = np.bincount(own, minlength=len(starts))
    known = words >= 0
    averages = Bag(own[known], words[known], 1 / sizes[own[known]], (len(starts), len(number)))
    text = np.repeat(np.arange(len(rows)), np.diff(ends))
    target = np.stack([1 - labels[text], labels[text]], 1)
    share = weights[text] / np.diff(ends)[text]
    share = (share / share.sum()).astype(np.float32)[:, None]
    own_word, cell = Grams(list(number), buckets).pairs()
    bags = Bag(own_word, cell, 1 / np.bincount(own_word, minlength=len(number))[own_word], (len(number), buckets))

    draw = np.random.default_rng(7)
    state = [draw.normal(0, 0.1, (buckets, DIMENSIONS)).astype(np.float32), draw.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32), np.zeros((1, 2), np.float32)]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in state]
    for step in range(1, rounds + 1):
        table, layer, bias = state
        vectors = averages.dot(bags.dot(table))
        logits = vectors @ layer + bias
        odds = 1 / (1 + np.exp(-np.clip(logits[:, 1] - logits[:, 0], -30, 30)))
        slope = np.stack([target[:, 1] - odds, odds - target[:, 1]], 1) * share
        down = bags.dot(averages.dot(slope @ layer.T, transposed=True), transposed=True)
        for x, g, (m, v) in zip(state, (down, vectors.T @ slope, slope.sum(0, keepdims=True)), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + SMOOTH)
    return (state[0] @ (state[1][:, 1] - state[1][:, 0])).astype(np.float64), float(state[2][0, 1] - state[2][0, 0])


def _logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with a slight pull to 0."""
    spread = np.maximum(features.std(0), 1e-6)
    spread[0] = 1
    x, out = features / spread, np.zeros(features.shape[1])
    weights = weights / weights.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        slope = x.T @ (weights * (p - labels)) + 0.5 * out
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(out))
        out = out - np.linalg.solve(curve, slope)
    return out / spread


def fit(texts: list[str | None], labels: np.ndarray, weights: np.ndarray, buckets: int = BUCKETS, rounds: int = ROUNDS) -> Model:
    """Learn the embeddings on two thirds of the texts, and the final scale on the others, whose words are not fitted."""
    labels, weights = np.asarray(labels, np.float32), np.asarray(weights, np.float64)
    share = (float(np.sum(weights * labels)) + 0.5) / (float(np.sum(weights)) + 1) if len(labels) else 0.0
    flat = Model(np.zeros(buckets), 0.0, (float(np.log(share / (1 - share))) if share else -30.0, 0.0, 0.0, 0.0))
    if len(set(labels.tolist())) < 2:
        return flat
    rows = [folded(t).split() for t in texts]
    learn = np.arange(len(rows)) % 3 != 2
    some = np.array([bool(r) for r in rows])
    at = np.flatnonzero(learn & some)
    if not len(at):
        return flat
    values, bias = _embed([rows[i] for i in at], labels[at], weights[at].astype(np.float32), buckets, rounds)
    model = Model(values, bias, ())
    other = np.flatnonzero(~learn) if len(set(labels[~learn].tolist())) == 2 else np.arange(len(rows))
    scale = _logistic(model.features([texts[i] for i in other]), labels[other], weights[other])
    return Model(values, bias, tuple(float(x) for x in scale))


def held_out(column: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    usable = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    usable = usable.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    totals = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    parts = [usable.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = keyed(docs, id_col, text_col).join(F.broadcast(chosen), "id").select("text", "label").toArrow()
    found = np.asarray(rows.column("label").to_numpy())
    drawn = {k: max(int(np.sum(found == k)), 1) for k in (0, 1)}
    weights = np.array([totals.get(k, 0) / drawn[k] for k in found.tolist()])
    return fit(rows.column("text").to_pylist(), found, weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 1 << 19):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist()))], ["id", "score"])

    source = keyed(docs, id_col, text_col)
    scored = source.mapInArrow(run, T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, 1 << 19):
            yield part.filter(pa.array(model.scores(part.column(column).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
