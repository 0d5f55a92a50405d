"""Decontamination against brute force."""

import hashlib
import random
import re

import pytest

from fareloom.llm import decontaminate as D

ITEMS = [
    ("b", " ".join(f"w{i}" for i in range(20))),
    ("a", " ".join(f"w{i}" for i in range(4, 20))),
    ("10", "Short item, HERE"),
    ("10", "Short item, HERE"),
    ("e", ""),
    ("n", None),
    (None, "nameless item of five words"),
    ("the", "the " * 15),
    ("é", "Été déjà vu été É"),
]


def documents():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(24)] + ["the"] * 8
    run = " ".join(f"W{i}" for i in range(20))
    made = [" ".join(draw.choices(vocabulary, k=draw.randint(0, 60))) for _ in range(40)]
    mixed = [f"x {run} y", f"{run} {run}", run[3:], "short-item.here", "shortitem here", "nameless item of five words", "the " * 40, "Été déjà vu été É", "été", "a " * 400 + run]
    return [None, "", *made, *mixed, "same", "same"]


def expected(text):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, owners = split(text), set(), set()
    for item, body in ITEMS:
        test = split(body)
        size = min(13, len(test))
        wins = {tuple(test[i : i + size]) for i in range(max(1, len(test) - 12))} if test else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in wins:
                hit.update(range(i, i + size))
                owners.update([item] if item is not None else [])
    digest = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
    return len(words), len(hit), len(owners), digest, bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("most", [D.BLOCK_BYTES, 100])
def test_brute_force(spark, monkeypatch, most):
    whole = D.item_blocks
    monkeypatch.setattr(D, "item_blocks", lambda *a: whole(*a, most=most))
    texts = documents()
    docs = spark.createDataFrame([(n // 2, t, 7) for n, t in enumerate(texts)], "doc_id long, text string, row int")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = D.decontaminate(docs, items).collect()
    wanted = sorted((n // 2, *expected(t)) for n, t in enumerate(texts))
    assert sorted(tuple(r) for r in found) == wanted
    assert sum(r.contaminated for r in found) > 5


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id string, text string")
    row = D.decontaminate(docs, items).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
    assert D.decontaminate(docs.limit(0), spark.createDataFrame(ITEMS, "item_id string, text string")).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue"), (2, "red x x x x blue"), (3, "blue red"), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in D.proximity(docs, ["Red blue"], 3).collect()) == [1, 3]
