"""Fingerprints: local consistency, likeness, and successors against brute force."""

import hashlib
import random

import numpy as np

from fareloom.llm import fingerprints as P


def names(text, level):
    x, rows = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    for _ in range(level):
        x, rows = P.parse(x, rows)
    return set(x.tolist())


def test_equal_substrings_share_interior_names():
    draw = random.Random(4)
    for _ in range(30):
        make = lambda n: bytes(draw.choices(b"abcdeeee   ", k=n))
        shared = make(2000)
        a, b = make(draw.randint(0, 200)) + shared + make(77), make(draw.randint(0, 200)) + shared
        common = names(a, 3) & names(b, 3)
        assert len(common) >= 0.8 * len(names(shared, 3))


def test_phrases_are_short_and_batches_do_not_matter():
    text = bytes(random.Random(1).choices(range(256), k=20_000))
    x, rows = P.parse(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(text) / 12 < len(x) < len(text) / 2
    texts = [b"", b"a", b"ab", b"aaaa" * 500, text[:100], text[50:300], b"", "é中".encode() * 40]
    assert P.fingerprints(texts) == [P.fingerprints([t])[0] for t in texts]
    assert len(set(P.fingerprints(texts))) == len(texts) - 1


def test_rows_and_successors(spark):
    draw = random.Random(9)
    text = lambda n: " ".join(draw.choices(["the", "of", "ünder", "lorem", "ipsum", "x"], k=n))
    rows = [(n * 3, text(draw.randint(0, 300))) for n in range(60)] + [(7, None), (8, ""), (9, "z"), (9, "y"), (None, "no id"), (200, text(40)), (199, text(40))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int")
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for parts in (1, 7):
        found = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in P.fingerprint_documents(df, parts=parts).collect()), key=repr)
        wanted = []
        for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
            h = len(t) // 2
            wanted.append((i, len(t), hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest()))
        assert found == sorted(wanted, key=repr)
    rows = P.fingerprint_documents(df).where("n_chars > 400").collect()
    assert all(0 <= r.near_next < 0.6 and 0.1 < r.near_edited <= 1 for r in rows)
    assert P.fingerprint_documents(df.limit(0)).count() == 0
    lone = P.fingerprint_documents(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    assert lone.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and lone.near_next == 1
