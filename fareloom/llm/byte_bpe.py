"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives the byte strings of all tokens. Bytes are written as characters (a fixed one-to-one table), the
merges follow from the ranks, and the library's BPE model runs on each match of the split pattern. Equal pieces
recur, so a worker keeps the ids of short pieces it has seen, up to a fixed number of bytes and for one partition. Decoding
reverses the table; a character whose bytes lie in several tokens is whole again once the bytes are joined.

Defined results: null and empty texts have no ids; decoding no ids (or null) gives empty bytes; unknown ids are an
error; ids of any type, repeated and null ids pass through; other columns are not looked at. Texts are encoded
whole; memory beyond one text is bounded by slices of half a MB.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.llm.common import keyed, slices

# What a worker keeps of the pieces it has seen; a piece and its ids take PIECE_BYTES and what their letters take.
KEPT_BYTES = 32 << 20
PIECE_BYTES = 200
LONGEST_KEPT = 48
SLICE_BYTES = 1 << 19
# Pieces that go to the library at once, as its results are large objects.
AT_ONCE = 4096


def byte_characters() -> dict[int, str]:
    """Byte to character: visible Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + n) for n, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes a token: what lower ranks alone make of its bytes."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            raise ValueError(f"no merges lead to token {token!r}")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


# The code points of Unicode's White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def splitter(pattern: str):
    """`findall` of a split pattern for the standard matcher, which is the faster one.

    Letters, numbers and white space are written out as ranges; a pattern with other properties is refused. Texts
    of the basic plane, nearly all, have a pattern of their own: its sets are looked up in one step.
    """
    basic, full = (_compiled(pattern, top) for top in (0x10000, 0x110000))
    return lambda text: (basic if len(text.encode("utf-16-le")) == 2 * len(text) else full).findall(text)


def _compiled(pattern: str, top: int):
    import re

    import regex

    every = "".join(chr(c) for c in range(top) if not 0xD800 <= c < 0xE000)

    def ranges(name: str) -> str:
        runs = (m.span() for m in regex.finditer(rf"\p{{{name}}}+", every))
        return "".join(f"\\U{ord(every[a]):08x}-\\U{ord(every[b - 1]):08x}" for a, b in _unbroken(every, runs))

    members = {r"\p{L}": ranges("L"), r"\p{N}": ranges("N"), r"\s": WHITE}
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((n for n in (*members, r"\S") if pattern.startswith(n, at)), pattern[at : at + 2 if pattern[at] == "\\" else at + 1])
        if name.startswith(r"\p") and name not in members:
            raise ValueError(f"not supported in a split pattern: {pattern[at:]}")
        inside = name == "[" or inside and name != "]"
        if name in members:
            out.append(members[name] if inside else f"[{members[name]}]")
        else:
            out.append(f"[^{WHITE}]" if name == r"\S" else name)
        at += len(name)
    return re.compile("".join(out))


def _unbroken(every: str, runs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Cut a run where the code points that are not characters were left out."""
    gap = every.index("\ue000")
    for a, b in runs:
        yield from ((a, gap), (gap, b)) if a < gap < b else ((a, b),)


class Codec:
    """One vocabulary in one worker; the model is only made where texts are encoded."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks_path, self.pattern = ranks_path, pattern
        self.table = dict(byte_characters())
        self.latin = {b: self.table[b] for b in range(256)}
        ranks = read_ranks(ranks_path)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.length_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for rank, token in self.bytes_of.items():
            self.length_of[rank] = len(token)
        self.known: dict[str, bytes] = {}
        self.kept = 0

    @cached_property
    def model(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        ranks = {t: r for r, t in self.bytes_of.items()}
        spell = lambda token: "".join(map(self.table.__getitem__, token))
        merges = [tuple(map(spell, last_merge(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
        return Tokenizer(BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges))

    @cached_property
    def split(self):
        return splitter(self.pattern)

    def _spelled(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.latin)

    def _learn(self, names: list[str]) -> None:
        """Add the ids of new pieces, as the bytes of 32-bit numbers."""
        for at in range(0, len(names), AT_ONCE):
            part = names[at : at + AT_ONCE]
            found = self.model.encode_batch([self._spelled(p) for p in part], add_special_tokens=False)
            self.known.update(zip(part, (array("i", e.ids).tobytes() for e in found), strict=True))
        self.kept += sum(map(len, names)) + PIECE_BYTES * len(names)

    def _forget(self, names: Iterable[str]) -> None:
        for name in names:
            del self.known[name]
            self.kept -= len(name) + PIECE_BYTES

    def forget_all(self) -> None:
        self.known, self.kept = {}, 0
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self.split(text) for text in texts]
        names = list(set(chain.from_iterable(pieces)).difference(self.known))
        self._learn(names)
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, row)), np.int32) for row in pieces]
        self._forget([name for name in names if len(name) > LONGEST_KEPT])
        while self.kept > KEPT_BYTES:
            self._forget(list(islice(self.known, (len(self.known) + 1) // 2)))  # the older half
        return ids

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point and end of each token; a token with a part of a character has that character's range."""
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.length_of[ids])
        begins = ends - self.length_of[ids]
        return character[begins].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)

    def decode(self, ids: Iterable[int] | None) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, () if ids is None else ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """The vocabulary, read once a worker."""
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def _encoded(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    """Slices of rows (id, text), their texts and the ids of these; what was learnt goes with the last slice."""
    for part in slices(batches, 1, SLICE_BYTES):
        texts = [t or "" for t in part.column(1).to_pylist()]
        yield part, texts, own.encode(texts)
    own.forget_all()


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Columns: the id, `ids` (array of int) and, if asked for, `token_start` and `token_end` in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for part, texts, ids in _encoded(own, batches):
            columns, names = [part.column(0), _lists(ids)], [id_col, "ids"]
            if offsets:
                spans = [own.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                columns += [_lists([s[k] for s in spans]) for k in (0, 1)]
                names += ["token_start", "token_end"]
            yield pa.RecordBatch.from_arrays(columns, names)

    source = keyed(df, id_col, text_col)
    lists = ["ids", *(["token_start", "token_end"] if offsets else [])]
    fields = [T.StructField(id_col, source.schema["id"].dataType), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in lists)]
    return source.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns: the id, `ids` as given and `decoded` (binary): the bytes of all tokens, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = part.column(1).flatten().to_numpy().tolist()
                ends = np.cumsum([0, *pc.list_value_length(part.column(1)).fill_null(0).to_pylist()]).tolist()
                raw = [own.decode(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], [id_col, "ids", "decoded"])

    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    fields = [T.StructField(id_col, source.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return source.mapInArrow(run, T.StructType(fields))


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of encoded and decoded rows."""
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids, and return the digests of both.

    One worker a task does both, slice by slice; `decode` after `encode` would hold two, and the ids of more rows between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for part, _, ids in _encoded(own, batches):
            raw = [own.decode(row.tolist()) for row in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids), pa.array(raw, pa.binary())], [id_col, "ids", "decoded"])

    source = keyed(df, id_col, text_col)
    fields = [T.StructField(id_col, source.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return digests(source.mapInArrow(run, T.StructType(fields)), id_col)
