"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fareloom.llm import lexical_search as S

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def expected(docs, items, top):
    held = [(i, terms(t)) for i, t in docs]
    count = sum(1 for _, t in held if t)
    length = sum(sum(t.values()) for _, t in held)
    frequency = Counter(w for _, t in held for w in t)
    out = []
    for name, text in items:
        scored = []
        for doc, own in held:
            score = 0
            for word, times in terms(text).items():
                if own[word]:
                    weight = math.floor(1000 * math.log((2 * count + 2) / (2 * frequency[word] + 1)))
                    m = 75 + 25 * sum(own.values()) * count // length
                    score += times * weight * ((1_000_000_000 * own[word]) // (1000 * own[word] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(name, rank + 1, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def made(draw, count=400):
    vocabulary = [f"W{int(draw.paretovariate(0.7))}" for _ in range(300)]
    docs = [(n, " ".join(draw.choices(vocabulary, k=draw.randint(0, 80)))) for n in range(count)]
    docs += [(1000 + n // 2, docs[3][1]) for n in range(90)]  # more copies than are listed
    docs += [(None, "rare w1 w1"), (None, None), (2000, ""), (2000, "rare rare"), (2001, "été RARE"), (2002, "w1 " * 5000)]
    items = [(n, " ".join(draw.choices(vocabulary, k=draw.randint(1, 40)))) for n in range(25)]
    items += [(100, docs[3][1]), (100, docs[3][1]), (None, "rare été"), (101, None), (102, ""), (103, "unheard-of"), (104, "w1 w1 W1 rare")]
    return docs, items


@pytest.mark.parametrize("top, block, entries", [(20, 1 << 22, 100_000), (20, 2000, 60), (3, 2000, 100_000)])
def test_brute_force(spark, monkeypatch, top, block, entries):
    docs, items = made(random.Random(12))
    whole = S.slices
    monkeypatch.setattr(S, "slices", lambda batches, column, most: whole(batches, column, block))
    table = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, score int, item_id int").repartition(4)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, doc_id int")
    found = S.search(table, asked, top=top, entries=entries)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(tuple(r) for r in found.collect()) == ordered(expected(docs, items, top))


def test_text_ids_and_empty_sides(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "one")], "item_id string, text string")
    assert [(r.rank, r.doc_id) for r in S.search(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]
    assert S.search(docs.where("false"), items).count() == 0
    assert S.search(docs, items.where("false")).count() == 0
    assert S.search(docs, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


def blocks_and_queries(draw):
    docs, items = made(draw)
    counts = [terms(t) for _, t in items]
    queries = S.Queries([Counter({w.encode(): n for w, n in c.items()}) for c in counts if c])
    held = [(sum(c.values()), {w.encode(): n for w, n in c.items()}) for c in (terms(t) for _, t in docs)]
    frequency = np.array([sum(t in own for _, own in held) for t in sorted(queries.number)])
    queries.weigh(frequency, sum(1 for n, _ in held if n), sum(n for n, _ in held))
    found = [[(queries.number[t], n, length) for t, n in own.items() if t in queries.number] for length, own in held]
    flat = np.array([x for row in found for x in row], np.int64)
    block = S.Block(np.array([len(row) for row in found]), flat[:, 0], queries.impacts(flat[:, 0], flat[:, 1], flat[:, 2]), len(queries.number))
    return block, queries


def test_bounds_hold_and_are_tighter_than_term_maxima():
    block, queries = blocks_and_queries(random.Random(13))
    joint, where = block.joint_maxima(queries.pairs)
    scratch, tighter = np.zeros(len(queries.number), np.int64), 0
    for item in queries.items:
        if not len(item.terms):
            continue
        bounds = block.chain_bounds(item, joint)
        for n in range(len(item.terms)):
            rest = S.Item(item.terms[n:], item.times[n:])
            assert block.scores(np.arange(block.size), rest, scratch).max() <= bounds[n]
        tighter += bounds[0] < (item.times * block.maxima[item.terms]).sum()
        assert (np.diff(bounds) <= 0).all()
    assert tighter > 10
    # Every joint maximum is what its document reaches.
    for (a, x, b, y), best, doc in zip(queries.pairs, joint, where, strict=True):
        own = dict(zip(block.terms[block.cuts[doc] : block.cuts[doc + 1]], block.impacts[block.cuts[doc] : block.cuts[doc + 1]], strict=True)) if doc >= 0 else {}
        assert best == (x * own[a] + y * own[b] if doc >= 0 else 0)


def test_limits_skip_documents_but_lose_none():
    block, queries = blocks_and_queries(random.Random(14))
    joint, _ = block.joint_maxima(queries.pairs)
    scratch = np.zeros(len(queries.number), np.int64)
    for item in queries.items:
        every = block.scores(np.arange(block.size), item, scratch)
        for limit in (0, int(np.median(every)), int(every.max()), int(every.max()) + 1):
            docs, scores = block.search(item, joint, limit)
            wanted = np.flatnonzero(every >= max(1, limit))
            assert docs.tolist() == wanted.tolist() and scores.tolist() == every[wanted].tolist()
