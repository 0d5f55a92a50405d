"""License scans: one Aho-Corasick automaton for notice phrases, one for identifier tags, and an expression parser.

Phrases are matched as whole words over the folded word stream of a text, so line breaks, comment signs and capitals do
not matter. `BASE` phrases are always reported. `NOTICES` are the method's own; of notices that lie inside a longer
notice only the longer one counts. A tag (`TAGS`) is looked for in the text as it stands, and the licence expression
after it is read by the shunting-yard algorithm: `with` binds closest, then `and`, then `or`; parentheses group. An
expression is evaluated while it is read: its identifiers become labels, and its openness is that of the better side
of an `or`, of the worse side of an `and`, and a step more for an exception.

Each text is scanned by itself in one pass, so nothing is shuffled; the cost is linear in the text however many matches it
has. Words: A-Z in lower case, then runs of ASCII letters, digits and any non-ASCII characters. Defined results: null and
empty texts have no words, no labels and a score of 0; an expression that breaks off (an operand or a parenthesis is missing, or
`with` stands between anything but a licence and an exception) is reported as not valid and gives no labels; ids of any
type, null and repeated ids pass through, each row is judged by itself; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.llm.common import keyed, slices
from fareloom.llm.decontaminate import words_of

# The phrases that are always reported, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notice phrases as words, and their labels.
NOTICES = {
    "apache license": "apache",
    "boost software license": "bsl-1",
    "cc by 4 0": "cc-by",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0",
    "common development and distribution license": "cddl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "dedicated to the public domain": "public-domain",
    "eclipse public license": "epl",
    "gnu affero general public license": "agpl",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "the unlicense": "unlicense",
}

# Tags that a licence expression follows; the words of each are looked for first.
TAGS = ("spdx-license-identifier:", "license-expression:")

# How much a licence family allows, by the beginning of its label; the longest one counts.
OPENNESS = {
    "0bsd": 1.0,
    "agpl": 0.3,
    "apache": 0.9,
    "bsd": 0.9,
    "bsl": 0.9,
    "cc-by": 0.9,
    "cc-by-nc": 0.1,
    "cc-by-nd": 0.2,
    "cc-by-sa": 0.6,
    "cc0": 1.0,
    "cddl": 0.6,
    "epl": 0.6,
    "gpl": 0.4,
    "isc": 0.9,
    "lgpl": 0.6,
    "mit": 0.9,
    "mpl": 0.6,
    "public-domain": 1.0,
    "unlicense": 1.0,
    "zlib": 0.9,
}
UNKNOWN_OPENNESS = 0.2
EXCEPTION_STEP, EXCEPTION_TOP = 0.2, 0.9
# How far one label of each kind shows that the text states a licence.
EVIDENCE = {"base": 0.9, "notice": 0.7, "tag": 0.95}

BINDING = {b"or": 1, b"and": 2, b"with": 3}
_TOKEN = re.compile(rb"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")


def label_of(identifier: str) -> str:
    """The label of an identifier: lower case, without a version's `.0` and without `only`, `or-later` and `+`.

    A full stop after it ends a sentence.
    """
    name = identifier.lower().rstrip(".").removesuffix("+").removesuffix("-only").removesuffix("-or-later").removesuffix(".0")
    return re.sub(r"-[0-9.]+$", "", name) if name.startswith("cc-by") else name


def openness_of(label: str) -> float:
    parts = label.split("-")
    return next((OPENNESS[name] for n in range(len(parts), 0, -1) if (name := "-".join(parts[:n])) in OPENNESS), UNKNOWN_OPENNESS)


class Expression:
    """The value of a part of an expression: its openness, its labels, and whether it is one identifier."""

    def __init__(self, openness: float, labels: set[str], single: bool = False):
        self.openness, self.labels, self.single = openness, labels, single


def _apply(operator: bytes, values: list[Expression]) -> bool:
    """Put the value of the last two values in their place; False if the operator does not allow them."""
    right, left = values.pop(), values.pop()
    if operator == b"with":
        if not (left.single and right.single):
            return False
        # An exception is no licence; it only opens the one before it.
        values.append(Expression(max(left.openness, min(EXCEPTION_TOP, left.openness + EXCEPTION_STEP)), left.labels))
        return True
    more, less = (left.labels, right.labels) if len(left.labels) >= len(right.labels) else (right.labels, left.labels)
    more.update(less)
    best = max if operator == b"or" else min
    values.append(Expression(best(left.openness, right.openness), more))
    return True


def read_expression(raw: bytes, at: int) -> tuple[int, Expression | None]:
    """The end of the expression that begins at `at` of a lower-case text, and its value if it is complete."""
    values: list[Expression] = []
    waiting: list[bytes] = []
    operand_next, end = True, at
    while found := _TOKEN.match(raw, end):
        token = found[1]
        if operand_next:
            if token == b")" or token in BINDING:
                break
            if token == b"(":
                waiting.append(token)
            else:
                label = label_of(token.decode())
                values.append(Expression(openness_of(label), {label}, single=True))
                operand_next = False
        elif token == b")":
            while waiting and waiting[-1] != b"(":
                if not _apply(waiting.pop(), values):
                    return found.end(), None
            if not waiting:
                break
            waiting.pop()
            values[-1].single = False
        elif token in BINDING:
            while waiting and waiting[-1] != b"(" and BINDING[waiting[-1]] >= BINDING[token]:
                if not _apply(waiting.pop(), values):
                    return found.end(), None
            waiting.append(token)
            operand_next = True
        else:
            break
        end = found.end()
    if operand_next or b"(" in waiting:
        return end, None
    while waiting:
        if not _apply(waiting.pop(), values):
            return end, None
    return end, values[0]


class Scanner:
    """The automata of one set of phrases and tags."""

    def __init__(self, base: Mapping[str, str], notices: Mapping[str, str], tags: tuple[str, ...]):
        self.words, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        wanted: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", base), ("notice", notices)):
            for phrase, label in phrases.items():
                wanted.setdefault(_stream(phrase), []).append((kind, label))
        for tag in tags:
            wanted.setdefault(_stream(tag), []).append(("tag", tag))
            self.tags.add_word(tag, len(tag))
        for key, values in wanted.items():
            if key.strip():
                self.words.add_word(key, (len(key), key.count(" ") - 1, values))
        self.words.make_automaton()
        self.tags.make_automaton()

    def phrases(self, stream: str) -> tuple[list[tuple[str, str, int, int]], bool]:
        """Kind, label, first word and end of the phrases in a word stream, and whether it has the words of a tag."""
        hits = list(self.words.iter(stream)) if len(self.words) else []
        if not hits:
            return [], False
        spaces = np.flatnonzero(np.frombuffer(stream.encode("latin-1"), np.uint8) == 32)
        firsts = np.searchsorted(spaces, [end - size + 1 for end, (size, _, _) in hits]).tolist()
        found = [(kind, label, first, first + words) for first, (_, (_, words, values)) in zip(firsts, hits, strict=True) for kind, label in values]
        tagged = any(kind == "tag" for kind, *_ in found)
        found = sorted((f for f in found if f[0] != "tag"), key=lambda f: (f[2], -f[3], f[0], f[1]))
        kept, reach = [], -1
        for hit in found:
            # Sorted by start, longest first: a notice that ends no later than one before it lies inside of it.
            if hit[0] == "notice":
                if hit[3] <= reach:
                    continue
                reach = hit[3]
            kept.append(hit)
        return kept, tagged

    def expressions(self, text: str) -> list[tuple[int, int, Expression | None]]:
        """First code point, end and value of the expressions after the tags of a text."""
        raw = text.encode().lower()
        out, free = [], 0
        for last, size in self.tags.iter(raw.decode("latin-1")):
            if last + 1 - size >= free:
                free, value = read_expression(raw, last + 1)
                out.append((last + 1, free, value))
        if not out:
            return out
        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        return [(int(points[a]), int(points[b]), value) for a, b, value in out]


def _stream(text: str | None) -> str:
    """The words of a text, each between spaces; a character stands for a byte."""
    words = words_of(text)
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


PLACE = "struct<kind:string,label:string,first:int,end:int,openness:double>"
TAGGED = "struct<start:int,end:int,valid:boolean,openness:double,labels:array<string>>"


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Mapping[str, str] = BASE, notices: Mapping[str, str] = NOTICES, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """One row per document: id, n_words, `places` (kind, label, first word, end and openness of every phrase) and `expressions`
    (code points from the tag to the end, validity, openness and labels of every tagged expression)."""
    places_kind = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("openness", pa.float64())]))
    tagged_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("valid", pa.bool_()), ("openness", pa.float64()), ("labels", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, tags)
        for part in slices(batches, 1):
            counts, places, tagged = [], [], []
            for text in part.column(1).to_pylist():
                stream = _stream(text)
                counts.append(max(0, stream.count(" ") - 1))
                found, has_tag = scanner.phrases(stream)
                places.append([dict(zip(("kind", "label", "first", "end"), f, strict=True), openness=openness_of(f[1])) for f in found])
                values = scanner.expressions(text) if has_tag else []
                tagged.append([{"start": a, "end": b, "valid": v is not None, "openness": v and v.openness, "labels": sorted(v.labels) if v else []} for a, b, v in values])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(places, places_kind), pa.array(tagged, tagged_kind)], names)

    names = ["id", "n_words", "places", "expressions"]
    source = keyed(docs, id_col, text_col)
    kinds = [source.schema["id"].dataType, T.LongType(), *(T.ArrayType(T._parse_datatype_string(x)) for x in (PLACE, TAGGED))]
    return source.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])).withColumnRenamed("id", id_col)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, openness, n_tags.

    `score` is 1 less the product of what each distinct kind and label leaves open; `openness` is that of the
    narrowest licence the text states, null if it states none.
    """
    found = find_licenses(docs, id_col, text_col, **named)
    base = F.filter("places", lambda p: p["kind"] == "base")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    tag_labels = F.flatten(F.transform("expressions", lambda e: e["labels"]))
    pair = lambda kind, label: F.struct(kind.alias("kind"), label.alias("label"))
    pairs = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: pair(p["kind"], p["label"])), F.transform(tag_labels, lambda x: pair(F.lit("tag"), x)))))
    weight = lambda kind: _chosen(kind, EVIDENCE)
    open_left = F.aggregate(pairs, F.lit(1.0), lambda left, p: left * (F.lit(1.0) - weight(p["kind"])))
    firsts = F.transform(base, lambda p: p["first"])
    valid = F.filter("expressions", lambda e: e["valid"])
    return found.select(
        F.col(f"`{id_col}`"),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).cast("long").alias("first_word"),
        F.array_max(firsts).cast("long").alias("last_word"),
        joined(F.transform(base, lambda p: p["label"])).alias("base_labels"),
        joined(F.concat(F.transform("places", lambda p: p["label"]), tag_labels)).alias("labels"),
        F.round(F.lit(1.0) - open_left, 9).alias("score"),
        F.array_min(F.concat(F.transform("places", lambda p: p["openness"]), F.transform(valid, lambda e: e["openness"]))).alias("openness"),
        F.size("expressions").cast("long").alias("n_tags"),
    )


def _chosen(key: Column, values: Mapping[str, float]) -> Column:
    (first, value), *rest = values.items()
    out = F.when(key == first, F.lit(value))
    for name, number in rest:
        out = out.when(key == name, F.lit(number))
    return out
