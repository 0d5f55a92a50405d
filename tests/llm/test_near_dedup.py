"""Near-duplicate classes against all pairs, and signatures against the similarity they stand for."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fareloom.llm import near_dedup as N
from fareloom.llm.graph import components


def shingles(text):
    words = text.split()
    runs = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [" ".join(words)] * bool(words)
    return Counter(runs)


def brute_force(rows):
    """Class per row index, by all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(t or "") for _, t in rows]
    for i, (_, t) in enumerate(rows):
        for j in range(i):
            u = rows[j][1]
            if t is None or u is None:
                continue
            common, total = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if t == u or (total and common >= 0.8 * total):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def documents(draw):
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for n in range(60):
        text = draw.choices(words, k=draw.choice([3, 8, 40, 150, 400]))
        for _ in range(draw.choice([1, 1, 2, 6])):
            copy = list(text)
            for _ in range(draw.choice([0, 0, 1, 2, 3, 30])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((len(rows), " ".join(copy)))
    line = " ".join(draw.choices(words, k=30))
    rows += [(len(rows) + k, f"{line} {draw.choice(words)} {k}") for k in range(40)]
    extra = [None, None, "", "", " ", "one", "one", "one two three four", "again " * 500, "again " * 520, "again " * 200]
    return rows + [(1000 + k, t) for k, t in enumerate(extra)] + [rows[3], (None, "nameless")]


def test_classes(spark):
    rows = documents(random.Random(8))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int")
    found = N.classify(df).collect()
    assert len(found) == len(rows)
    wanted, members = brute_force(rows), {}
    for n, (i, t) in enumerate(rows):
        members.setdefault(wanted[n], []).append(i)
    least = {i: min((m for m in members[wanted[n]] if m is not None), default=None) for n, (i, t) in enumerate(rows)}
    for r in found:
        assert r.class_id == least[r.doc_id], r
    sizes = {i: len(members[wanted[n]]) for n, (i, _) in enumerate(rows)}
    assert all(r.class_size == sizes[r.doc_id] for r in found)

    kept = N.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, set(least.values())))


def test_classes_that_share_an_id(spark):
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(400)]
    texts = [" ".join(draw.choices(words, k=60)) for _ in range(12)]
    rows = [(None, t) for t in texts[:6]] + [(None, texts[0]), (None, texts[1] + " end")]  # six classes without any id
    rows += [(7, texts[6]), (7, texts[7]), (7, texts[8] + " end"), (7, texts[8])]  # three classes with one id
    rows += [(None, texts[9]), (3, texts[9]), (None, texts[10] + " end"), (4, texts[10]), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    roots = brute_force(rows)

    kept = [(r.doc_id, r.text) for r in N.keep_one(df).collect()]
    place = {row: root for row, root in zip(rows, roots, strict=True) if row[1] is not None}
    assert sorted(place[k] for k in kept if k[1] is not None) == sorted({r for (_, t), r in zip(rows, roots, strict=True) if t is not None})
    assert (3, texts[9]) in kept and (4, texts[10]) in kept
    assert kept.count((None, None)) == 2

    found = N.classify(df).collect()
    sizes = Counter(r.class_name for r in found)
    assert sizes.pop(None) == 2
    assert len(found) == len(rows) and sorted(sizes.values()) == sorted(Counter(r for (_, t), r in zip(rows, roots, strict=True) if t is not None).values())
    assert all(r.class_size == sizes.get(r.class_name, 1) for r in found)


def test_signatures_estimate_similarity():
    draw = random.Random(2)
    words = [str(draw.random()) for _ in range(800)]
    other = words[:400] + [str(draw.random()) for _ in range(100)] + words[500:]
    keys, rows = N.regions(pa.array([" ".join(words), " ".join(other), "", "x"]))
    a, b = (set(keys[rows[i] : rows[i + 1]].tolist()) for i in (0, 1))
    best = N.signatures(keys, rows)
    assert abs(np.mean(best[0] == best[1]) - len(a & b) / len(a | b)) < 0.15
    assert (best[[0, 1, 3]] != np.uint64(2**64 - 1)).all() and (best[2] == np.uint64(2**64 - 1)).all()


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    draw = random.Random(5)
    pairs = {"path": [(i, i + 1) for i in range(40)], "star": [(500, i) for i in range(60)], "random": [(draw.randrange(80), draw.randrange(80)) for _ in range(60)]}[shape]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    groups = {i: {i} for p in pairs for i in p}
    for a, b in pairs:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for i in groups[b]:
                groups[i] = groups[a]
    assert found == {i: min(g) for i, g in groups.items() if len(g) > 1}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.classify(empty).count() == 0 and N.keep_one(empty).count() == 0
