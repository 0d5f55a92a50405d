"""Licence scans against a word-by-word search, and expressions against a recursive reading."""

import random
import re
import time

import pytest

from fareloom.llm import licenses as L

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_places(text):
    own, out = words(text), []
    for phrase, label in L.BASE.items():
        wanted = phrase.split()
        out += [(n, label) for n in range(len(own)) if own[n : n + len(wanted)] == wanted]
    return len(own), sorted(out)


def documents():
    draw = random.Random(5)
    pieces = [*L.BASE, *L.NOTICES, "Apache-License,\n * Version 2.0", "under", "the", "mit", "license", "CC-BY", "nc", "été", "x"]
    made = [" ".join(draw.choices(pieces, k=draw.randint(0, 30))) for _ in range(60)]
    tags = ["// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND BSD-3-Clause", "License-Expression: MIT AND (", "é SPDX-LICENSE-IDENTIFIER: cc-by-nc-4.0."]
    return [None, "", " ", *made, *tags, "same under the mit license", "same under the mit license", "underthe mit license", "under the mit licenses"]


def test_base_against_word_search(spark):
    texts = documents()
    docs = spark.createDataFrame([(n, t, "x", 1) for n, t in enumerate(texts)], "doc_id long, text string, labels string, places int")
    found = {r.doc_id: r for r in L.scan(docs).collect()}
    assert len(found) == len(texts)
    for n, text in enumerate(texts):
        count, places = base_places(text)
        starts = [p for p, _ in places]
        row = found[n]
        assert (row.n_words, row.n_base) == (count, len(places))
        assert (row.first_word, row.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert row.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1 and (row.score > 0) == bool(row.labels)
    assert sum(r.n_base for r in found.values()) > 30


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(None, "under the MIT License"), (None, "under the MIT License"), (1, None), (1, "cc by nc")]
    found = L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_base, r.labels) for r in found) == [("1", 0, ""), ("1", 1, "cc-by-nc"), ("None", 1, "mit"), ("None", 1, "mit")]
    assert L.scan(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    assert L.scan(spark.createDataFrame(rows, "doc_id long, text string"), base={}, notices={}, tags=()).where("n_base > 0").count() == 0


def test_longer_notice_takes_the_place_of_shorter(spark):
    text = "GNU General Public License, version 3. GNU General Public License"
    places = L.find_licenses(spark.createDataFrame([("a", text)], "doc_id string, text string")).first().places
    assert [(p.label, p.first, p.end) for p in places] == [("gpl-3", 0, 6), ("gpl", 6, 10)]


def test_spans_of_tagged_expressions(spark):
    text = "é\n# SPDX-License-Identifier: MIT or Apache-2.0 */\nLicense-Expression: GPL-2.0 with"
    row = L.find_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [text[e.start : e.end] for e in row.expressions] == [" MIT or Apache-2.0", " GPL-2.0 with"]
    assert [(e.valid, e.openness, e.labels) for e in row.expressions] == [(True, 0.9, ["apache-2", "mit"]), (False, None, [])]


@pytest.mark.parametrize(
    "text, labels, openness",
    [
        ("mit", {"mit"}, 0.9),
        ("gpl-2.0-or-later", {"gpl-2"}, 0.4),
        ("mit or gpl-3.0 and cc-by-nc-4.0", {"mit", "gpl-3", "cc-by-nc"}, 0.9),
        ("(mit or gpl-3.0) and cc-by-nc-4.0", {"mit", "gpl-3", "cc-by-nc"}, 0.1),
        ("gpl-2.0 with classpath-exception-2.0 and mit", {"gpl-2", "mit"}, 0.4 + 0.2),
        ("mit and mylicense", {"mit", "mylicense"}, 0.2),
        ("((mit))", {"mit"}, 0.9),
        ("mit) or x", {"mit"}, 0.9),
        ("mit, and so on", {"mit"}, 0.9),
    ],
)
def test_expressions(text, labels, openness):
    _, value = L.read_expression(text.encode(), 0)
    assert value.labels == labels and value.openness == pytest.approx(openness)


@pytest.mark.parametrize("text", ["", "and", "mit and", "(mit", "mit or (", "(mit) with x-exception", "mit with x with y", ")"])
def test_broken_expressions(text):
    assert L.read_expression(text.encode(), 0)[1] is None


def recursive(tokens):
    """The same value, read by recursive descent."""

    def atom():
        if tokens[0] == "(":
            tokens.pop(0)
            value = either()
            tokens.pop(0)
            return value
        name = L.label_of(tokens.pop(0))
        value = L.openness_of(name), {name}
        if tokens and tokens[0] == "with":
            del tokens[:2]
            value = max(value[0], min(L.EXCEPTION_TOP, value[0] + L.EXCEPTION_STEP)), value[1]
        return value

    def both():
        value = atom()
        while tokens and tokens[0] == "and":
            tokens.pop(0)
            other = atom()
            value = min(value[0], other[0]), value[1] | other[1]
        return value

    def either():
        value = both()
        while tokens and tokens[0] == "or":
            tokens.pop(0)
            other = both()
            value = max(value[0], other[0]), value[1] | other[1]
        return value

    return either()


def test_random_expressions():
    draw = random.Random(11)

    def made(depth):
        kind = draw.random()
        if depth == 0 or kind < 0.3:
            return draw.choice(["mit", "gpl-3.0", "apache-2.0", "cc0-1.0", "mpl-2.0", "cc-by-nd-4.0", "gpl-2.0 with classpath-exception-2.0", "agpl-3.0 with font-exception"])
        if kind < 0.45:
            return f"( {made(depth - 1)} )"
        return f"{made(depth - 1)} {draw.choice(['and', 'or'])} {made(depth - 1)}"

    for _ in range(300):
        text = made(5)
        end, value = L.read_expression(text.encode(), 0)
        assert end == len(text)
        assert (value.openness, value.labels) == recursive(text.split())


def test_long_texts_take_linear_time(spark):
    """Texts of a million words with a match in nearly every place, tags with one long expression, and many tags."""
    texts = ["under the mit license " * 300_000, "SPDX-License-Identifier: " + "mit or gpl-3.0 and " * 100_000 + "mit", "SPDX-License-Identifier: mit\n" * 60_000, "(" * 1_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    began = time.time()
    found = {r.doc_id: r for r in L.scan(docs).collect()}
    assert time.time() - began < 60
    assert (found[0].n_base, found[0].last_word) == (300_000, 1_199_996)
    assert (found[1].labels, found[1].n_tags, found[2].n_tags) == ("gpl-3,mit", 1, 60_000)
