"""Near-duplicate documents with DartMinHash.

A text is a weighted set: its shingles of five words and how often each occurs. Each unit of weight is a region
into which darts are thrown by hashing, at a rate of one per unit of rank, so the number and places of darts depend on
the region alone. Darts carry one of `COORDINATES` coordinates; a text looks at ranks only up to where it expects a
few darts per coordinate, and keeps the earliest dart of each. Two texts keep the same dart of a coordinate with
the probability of their weighted Jaccard similarity.

Signatures are cut into bands; texts that share a band are candidates. Exact copies are put together first, by digest.
In a band's bucket all texts are compared with the one that shares most buckets with others, the leader. Texts with no link to
it are compared with all texts that have the same leader, as packs of texts against blocks of texts inside a task, so that only links
come out; no group is turned into all its pairs. Signatures that agree too little to be similar are set aside, for the
others the similarity is computed from the texts. Links of at least `SIMILARITY` make classes; a class has its smallest document id
and, as ids can be null or repeated, the smallest digest of its texts as a name.

Words are separated by white space and not changed. Defined results: texts of one to four words are one shingle;
texts without words only join equal texts; a null text is a class of its own; repeated rows count as one document and are
in one class; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareloom.llm.common import Words, keyed, mix, rolling, slices, stored
from fareloom.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
# A pair at the limit has 100 equal coordinates of 125 on average, with a deviation of 4.5; 75 are 5.6 deviations less.
LEAST_EQUAL = 75
# Texts without a link, and texts they are compared with, in one task's step.
PACK, BLOCK = 32, 128
# Rank intervals: from 0 to 1/64, then each as long as all before it.
_EDGES = np.array([0.0, *(2.0 ** np.arange(-6, 20))])
_DARTS = COORDINATES * (np.log(COORDINATES) + 4)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def regions(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit key per unit of weight of each text, and the keys of each row; keys of a text are distinct."""
    words = Words(column)
    hashes, rows = words.hashes[0], words.rows
    sizes = np.diff(rows)
    windows = rolling(hashes, SHINGLE)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = owner[: len(windows)] == owner[SHINGLE - 1 :] if len(windows) else np.zeros(0, bool)
    keys, own = [windows[whole]], [owner[: len(windows)][whole]]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(sizes == size)
        if len(short):
            at = rows[:-1][short][:, None] + np.arange(size)
            keys.append(mix((hashes[at] * (np.uint64(2) * np.arange(size, dtype=np.uint64) + np.uint64(1))).sum(1) + np.uint64(size)))
            own.append(short)
    key, own = np.concatenate(keys), np.concatenate(own)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    turn = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return mix(key + turn.astype(np.uint64) * _STEP), np.searchsorted(own, np.arange(len(sizes) + 1))


def _thresholds(length: float) -> np.ndarray:
    """The cumulated Poisson probabilities, for counting an interval's darts by a hash."""
    counts = np.arange(int(length + 12 * np.sqrt(length) + 12))
    logs = np.concatenate([[0.0], np.cumsum(np.log(counts[1:]))])
    return np.cumsum(np.exp(counts * np.log(length) - length - logs))


def throw(keys: np.ndarray, own: np.ndarray, low: float, high: float, best: np.ndarray) -> None:
    """Throw the darts of one rank interval into regions, and keep the earliest per row and coordinate in `best`."""
    salt = np.array([(int(low * 64) + 1) * 0xA24BAED4963EE407 % 2**64], np.uint64)
    hashes = mix(keys + salt)
    shares = (hashes >> np.uint64(11)).astype(np.float64) * 2.0**-53
    bounds = _thresholds(high - low)
    hit = np.flatnonzero(shares > bounds[0])
    counts = np.searchsorted(bounds, shares[hit], side="left")
    at = np.repeat(hit, counts)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    value = mix(hashes[at] + (turn.astype(np.uint64) + np.uint64(1)) * _STEP)
    rank = (low + (high - low) * ((value >> np.uint64(40)).astype(np.float64) * 2.0**-24)).astype(np.float32)
    place = own[at] * COORDINATES + (value & np.uint64(0xFFFFFFFF)).astype(np.int64) % COORDINATES
    tag = mix(value) & np.uint64(0xFFFFFFFF)
    np.minimum.at(best, place, (rank.view(np.uint32).astype(np.uint64) << np.uint64(32)) | tag)


def signatures(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Earliest darts, rank and tag in one number, per row and coordinate; rows without regions keep the highest number."""
    count = len(rows) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(count * COORDINATES, empty)
    sizes = np.diff(rows)
    own = np.repeat(np.arange(count), sizes)
    reach = np.where(sizes > 0, _DARTS / np.maximum(sizes, 1), 0.0)
    done = np.zeros(count)
    while True:
        for low, high in zip(_EDGES, _EDGES[1:], strict=False):
            rows_now = (reach > low) & (done <= low)
            if rows_now.any():
                at = np.flatnonzero(rows_now[own])
                throw(keys[at], own[at], float(low), float(high), best)
                done[rows_now] = high
        missing = (sizes > 0) & (best.reshape(count, COORDINATES) == empty).any(1)
        if not missing.any():
            return best.reshape(count, COORDINATES)
        reach[missing] = done[missing] * 1.01  # they look one interval further


def band_hashes(best: np.ndarray) -> np.ndarray:
    """One 64-bit hash per row and band, different for every band."""
    parts = best.reshape(len(best), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _STEP, (len(best), BANDS)).copy()
    for n in range(ROWS):
        out = mix((out + parts[:, :, n]) * np.uint64(0xD6E8FEB86659FD93))
    return out


def sign(docs: DataFrame) -> DataFrame:
    """Rows (id, node, bands, sketch) for rows (id, text): node is the text's digest; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 1 << 20):
            keys, rows = regions(part.column(2))
            best = signatures(keys, rows)
            some = np.diff(rows) > 0
            hashes = band_hashes(best[some]).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.reshape(-1)))
            sketch = pa.array([row.tobytes() for row in (best & np.uint64(0xFF)).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bands, sketch], ["id", "node", "bands", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    digested = docs.select("id", F.unhex(F.md5("text")).alias("node"), "text")
    return digested.mapInArrow(run, f"id {kind}, node binary, bands array<long>, sketch binary")


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose signatures do not rule out similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, COORDINATES) for n in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= LEAST_EQUAL))

    sides = [nodes.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")) for side in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a binary, b binary")


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs with their exact weighted Jaccard similarity, if it reaches the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] | None = None
        for part in slices(batches, 3, 1 << 20):
            keep = []
            keys, rows = regions(part.column(3))
            for n, node in enumerate(part.column(0).to_pylist()):
                if last is None or last[0] != node:
                    last = node, regions(part.column(2).slice(n, 1))[0]
                other = keys[rows[n] : rows[n + 1]]
                keep.append(_reaches(last[1], other))
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sides = [texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")) for side in "ab"]
    met = pairs.join(sides[1].hint("merge"), "b").join(sides[0].hint("merge"), "a")
    return met.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _loose_links(groups: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of the texts that have none to their leader, with all texts of that leader.

    `groups` has leader, node and linked. Texts go to packs and blocks by their hash; each pack meets each block of its leader.
    """
    sizes = groups.groupBy("leader").agg(F.count("*").alias("size"), F.sum((~F.col("linked")).cast("int")).alias("loose")).where("loose > 0 AND size > 1")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 1 << 20):
            found, rows = regions(part.column(1))
            packed = [np.sort(found[a:b]).tobytes() for a, b in zip(rows.tolist(), rows[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["node", "keys"])

    wanted = groups.join(sizes, "leader")
    details = texts.join(wanted.select("node").distinct().hint("merge"), "node").select("node", "text").mapInArrow(keys, "node binary, keys binary")
    details = stored(details.join(nodes.select("node", "sketch"), "node"), "group-texts")
    full = wanted.join(details, "node").withColumn("item", F.struct("node", "sketch", "keys"))
    turn = lambda count, most: F.pmod(F.xxhash64("node"), F.ceil(F.col(count) / most))
    blocks = full.groupBy("leader", turn("size", BLOCK).alias("block")).agg(F.collect_list("item").alias("block_items"))
    packs = full.where("NOT linked").groupBy("leader", turn("loose", PACK).alias("pack")).agg(F.collect_list("item").alias("pack_items"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                pack, block = (batch.column(c)[n].as_py() for c in (0, 1))
                marks = [np.frombuffer(b"".join(i["sketch"] for i in side), np.uint8).reshape(-1, COORDINATES) for side in (pack, block)]
                sets = [np.frombuffer(i["keys"], np.uint64) for i in block]
                found = []
                for item, mark in zip(pack, marks[0], strict=True):
                    mine = np.frombuffer(item["keys"], np.uint64)
                    for j in np.flatnonzero((marks[1] == mark).sum(1) >= LEAST_EQUAL).tolist():
                        if block[j]["node"] != item["node"] and _reaches(mine, sets[j]):
                            found.append((item["node"], block[j]["node"]))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return packs.join(blocks, "leader").select("pack_items", "block_items").mapInArrow(compare, "a binary, b binary")


def _reaches(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= SIMILARITY * (len(a) + len(b) - common) - 1e-9


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) for similar different texts, enough of them to connect every text with its class."""
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = stored(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared-buckets")
    members = stored(buckets.join(shared, "bucket"), "buckets")
    central = stored(members.groupBy("node").agg(F.sum("n").alias("met")), "central")
    leaders = members.select("bucket", "node").join(central, "node").groupBy("bucket").agg(F.min(F.struct((-F.col("met")).alias("met"), "node"))["node"].alias("leader"))
    groups = stored(members.select("bucket", "node").join(stored(leaders, "leaders"), "bucket").where("node <> leader").select("leader", "node").distinct(), "groups")
    involved = groups.select("node").unionByName(groups.select(F.col("leader").alias("node"))).distinct()
    texts = docs.select(F.unhex(F.md5("text")).alias("node"), "text").join(involved.hint("merge"), "node").dropDuplicates(["node"])  # the same join at every size
    texts = stored(texts, "candidate-texts")
    pairs = groups.select(F.col("leader").alias("a"), F.col("node").alias("b"))
    first = stored(_similar(stored(_agreeing(pairs, nodes), "agreeing"), texts), "links")
    linked = first.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.lit(True).alias("linked"))
    groups = stored(groups.join(linked, ["leader", "node"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "groups")
    return first.unionByName(stored(_loose_links(groups, texts, nodes), "links")).distinct()


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class), class_size (documents in it) and class_name.

    The name is the smallest digest of the class's texts, as classes of repeated or null ids can share a class_id; a null
    text, a class of its own, has none.
    """
    source = keyed(docs, id_col, text_col)
    return _classified(source, stored(sign(source), "signatures"), id_col)


def _classified(source: DataFrame, signed: DataFrame, id_col: str) -> DataFrame:
    named = _classes(source, signed)
    rows = signed.select("id", "node").join(named, "node", "left")
    return rows.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.lower(F.hex("root")).alias("class_name"))


def _classes(source: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, root, class_id, class_size, first) of every different text; first is the class's text that stays.

    It is the one with the smallest id, nulls last, and of texts with the same id the one with the smallest digest.
    """
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes, "nodes")
    roots = components(links(source, nodes))
    rooted = nodes.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted, "rooted")
    order = F.struct(F.col("least").isNull().alias("nameless"), "least", "node")
    classes = rooted.groupBy("root").agg(F.min(order).alias("first"), F.sum("copies").alias("class_size"))
    return rooted.select("node", "root").join(classes, "root").select("node", "root", F.col("first.least").alias("class_id"), "class_size", F.col("first.node").alias("first"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one document of each class, the one with the smallest id; null texts stay."""
    source = keyed(docs, id_col, text_col)
    named = _classes(source, stored(sign(source), "signatures"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col(f"`{id_col}`").alias("own_id"), F.unhex(F.md5(F.col(f"`{text_col}`").cast("string"))).alias("own_node"))
    kept = named.where(F.col("node") == F.col("first")).select(F.col("node").alias("own_node"), "class_id")
    null_text = whole.where("own_node IS NULL").select("whole.*")
    met = whole.join(kept.hint("merge"), "own_node").where(F.col("own_id").eqNullSafe(F.col("class_id")))
    once = met.withColumn("turn", F.row_number().over(Window.partitionBy("own_node").orderBy("own_id"))).where("turn = 1")
    return once.select("whole.*").unionByName(null_text)
