"""Substring dedup with a compacted de Bruijn graph over words.

A window is 20 consecutive words; a word goes if it lies in a window whose words also start earlier (smaller id, or the same
document and an earlier start). Instead of all windows, each document gives its anchors: the runs of `K` words with the smallest hash
of some window, about one in seven; equal windows have equal anchors at equal places. Anchors are the nodes of the
graph, the words from one anchor to the end of the next are its edges.

1. Nodes are counted; nodes that occur once are in no repeated window.
2. For the others, a join tells whether all occurrences have one edge in or one edge out. Where an edge is the only one
   out of its node and the only one into the next, the path does not branch, and consecutive anchors of a document become one
   path. Every occurrence of a part of a path lies in an occurrence of the whole path, so one
   decision holds for all windows inside it.
3. The documents give, from their own words, a 128-bit hash of each path and of each window that has a repeated anchor but
   lies in no path. The smallest coordinate (id, text, start) of each hash is the source; all other spans are removed.

Words are runs of anything but ASCII white space. Defined results: null and empty texts have no words; repeated rows count as
one document; rows without id come before all others, and different texts with one id in the order of their hash; other columns
are not looked at. Texts meet the anchors, and then the spans, by id; all lists are of one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.llm.common import SPACES, Words, keyed, mix, rolling, slices, stored

WIDTH = 20
K = 8
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BASE = np.uint64(0xD1342543DE82EF95)


def anchors(hashes: np.ndarray, rows: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of K words, and for each window inside a row: its first word and its anchor's."""
    runs = rolling(hashes, K)
    count = max(0, len(hashes) - width + 1)
    best, at = runs[:count].copy(), np.zeros(count, np.int64)
    for shift in range(1, width - K + 1):
        other = runs[shift : shift + count]
        less = other < best
        best[less] = other[less]
        at[less] = shift
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    inside = np.flatnonzero(owner[:count] == owner[width - 1 :]) if count else np.zeros(0, np.int64)
    return runs, inside, (inside + at[inside]), owner


def nodes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (id, copy, pos, node, edge_in, edge_out) of all anchors; an edge is 0 where the document begins or ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 1 << 20):
            words = Words(part.column(2))
            hashes, rows = words.hashes[0], words.rows
            runs, _, picked, owner = anchors(hashes, rows, width)
            place = np.unique(picked)
            if not len(place):
                continue
            row = owner[place]
            same = row[1:] == row[:-1]
            gap = np.where(same, np.diff(place), 0)
            # The words between two anchors' beginnings, then the second anchor, name the edge.
            prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes) * (np.arange(len(hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)))])
            flat = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes))])
            begin, end = place[:-1], place[:-1] + gap
            level = flat[end] - flat[begin]
            between = prefix[end] - prefix[begin] - level * (begin.astype(np.uint64) * np.uint64(2))
            edge = mix(between + runs[place[1:]] * _BASE + gap.astype(np.uint64))
            edge = np.where(same, (edge | np.uint64(1)).view(np.int64), 0)
            edge_out, edge_in = np.append(edge, 0), np.append(0, edge)
            columns = [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array((place - rows[row]).astype(np.int32)), pa.array(runs[place].view(np.int64)), pa.array(edge_in), pa.array(edge_out)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "copy", "pos", "node", "edge_in", "edge_out"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, copy long, pos int, node long, edge_in long, edge_out long")


def repeated(found: DataFrame) -> DataFrame:
    """Occurrences (id, copy, pos, left, right) of nodes that occur twice or more; left and right: that edge is the only one."""
    # Stored, the counted side has a shuffle of its own, and Spark can split the rows of a frequent node in the join.
    often = stored(found.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "repeated-nodes")
    again = stored(found.join(often, "node"), "repeated-anchors")
    only = lambda edge: (F.min(edge) == F.max(edge)) & (F.min(edge) != 0)
    shape = stored(again.groupBy("node").agg(only("edge_in").alias("left"), only("edge_out").alias("right")), "node-shapes")
    return again.join(shape, "node").select("id", "copy", "pos", "left", "right")


def _paths(places: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges of the paths that a document's repeated anchors make; `own`: all its anchors."""
    if not len(places):
        return []
    index = np.searchsorted(own, places)
    joined = (np.diff(index) == 1) & right[:-1] & left[1:]
    firsts = np.concatenate([[0], np.flatnonzero(~joined) + 1])
    lasts = np.append(firsts[1:], len(places)) - 1
    return list(zip(places[firsts].tolist(), (places[lasts] + K).tolist(), strict=True))


def spans(met: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (h1, h2, size, id, copy, start) of the paths, and of windows with a repeated anchor outside of them.

    `met` has id, copy, text and the document's repeated anchors in order: pos, left, right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 1 << 20):
            words = Words(part.column(2), seeds=SEEDS)
            rows = words.rows
            _, begins, picked, owner = anchors(words.hashes[0], rows, width)
            whole = [rolling(h, width) for h in words.hashes]
            lists = part.column(3)
            ends = np.concatenate([[0], np.cumsum([v or 0 for v in pa.compute.list_value_length(lists).to_pylist()])])
            flat = lists.flatten()
            pos, left, right = (flat.field(n).to_numpy(zero_copy_only=False) for n in range(3))
            bounds = np.searchsorted(begins, rows)
            out: list[tuple[np.ndarray, ...]] = []
            for n in range(part.num_rows):
                a, b = ends[n], ends[n + 1]
                windows = begins[bounds[n] : bounds[n + 1]] - rows[n]
                if a == b or not len(windows):
                    continue
                mine = picked[bounds[n] : bounds[n + 1]] - rows[n]
                paths = _paths(pos[a:b], left[a:b].astype(bool), right[a:b].astype(bool), np.unique(mine))
                ready = np.zeros(len(windows) + 1, np.int64)
                for first, end in paths:
                    if end - first >= width:
                        ready[first] += 1
                        ready[end - width + 1] -= 1
                        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(end - first - 1, _BASE)]))
                        pair = [mix(np.array([np.sum(h[rows[n] + first : rows[n] + end] * power)])) for h in words.hashes]
                        out.append((*pair, np.array([end - first]), np.array([n]), np.array([first])))
                loose = windows[np.isin(mine, pos[a:b]) & (np.cumsum(ready)[:-1] == 0)]
                at = loose + rows[n]
                out.append((whole[0][at], whole[1][at], np.full(len(at), width), np.full(len(at), n), loose))
            if out:
                h1, h2, size, row, start = (np.concatenate(c) for c in zip(*out, strict=True))
                columns = [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(size.astype(np.int32)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(start.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "size", "id", "copy", "start"])

    kind = met.schema["id"].dataType.simpleString()
    return met.mapInArrow(run, f"h1 long, h2 long, size int, id {kind}, copy long, start int")


def later(found: DataFrame) -> DataFrame:
    """The spans (id, copy, start, size) that are not the first ones of their words."""
    here = F.struct("id", "copy", "start")
    # Stored, as in `repeated`: a passage that very many documents share is split in the join.
    first = stored(found.groupBy("h1", "h2", "size").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "sources")
    return found.join(first, ["h1", "h2", "size"]).where(~here.eqNullSafe(F.col("first"))).select("id", "copy", "start", "size")


def cut(met: DataFrame, id_col: str) -> DataFrame:
    """Digests of what is left of each text once the word ranges in `gone` (start, size) are taken out."""
    names = [id_col, "n_words", "n_removed", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 1 << 20):
            total, removed, digest = [], [], []
            for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = split_words(text)
                left = kept_words(words, [(g["start"], g["size"]) for g in gone or ()])
                total.append(len(words))
                removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names)

    kinds = [met.schema["id"].dataType, T.LongType(), T.LongType(), T.StringType()]
    return met.select("id", "text", "gone").mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


_FOLD = bytes(32 if SPACES[b] else b for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return [w for w in text.encode().translate(_FOLD).split(b" ") if w] if text else []


def kept_words(words: list[bytes], gone: list[tuple[int, int]]) -> list[bytes]:
    left, at = [], 0
    for start, size in sorted(gone):
        if start + size > at:
            left += words[at : max(at, start)]
            at = start + size
    return left + words[at:]


def removed_spans(docs: DataFrame) -> DataFrame:
    """(id, copy, gone) for rows (id, copy, text): the word ranges to remove, of documents that have any."""
    found = repeated(nodes(docs)).groupBy("id", "copy").agg(F.sort_array(F.collect_set(F.struct("pos", "left", "right"))).alias("anchors"))
    listed = stored(found.withColumnsRenamed({"id": "own", "copy": "own_copy"}), "anchors")
    met = docs.join(listed, docs["id"].eqNullSafe(listed["own"]) & (docs["copy"] == listed["own_copy"])).select("id", "copy", "text", "anchors")
    gone = later(stored(spans(met), "spans"))
    return gone.groupBy("id", "copy").agg(F.collect_set(F.struct("start", "size")).alias("gone"))


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    source = keyed(docs, id_col, text_col).select("id", F.xxhash64("text").alias("copy"), "text")
    gone = stored(removed_spans(source).withColumnsRenamed({"id": "own", "copy": "own_copy"}), "gone")
    met = source.join(gone, source["id"].eqNullSafe(gone["own"]) & (source["copy"] == gone["own_copy"]), "left")
    return cut(met, id_col)


# The same rows in SQL for an independent engine.
SQL = r"""
WITH letters AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents)),
wins AS (SELECT r, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM letters WHERE len(w) >= 20)),
numbered AS (SELECT r, i, row_number() OVER (PARTITION BY h ORDER BY r, i) AS turn FROM wins),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 20)) AS p FROM numbered WHERE turn > 1) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [w[p] for p in range(1, len(w) + 1) if NOT list_contains(ps, p)] END, ' '), '')) AS kept_sha256
FROM documents d JOIN letters l ON d.doc_id IS NOT DISTINCT FROM l.doc_id AND d.text IS NOT DISTINCT FROM l.text LEFT JOIN gone USING (r)
"""
