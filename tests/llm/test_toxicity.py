"""Toxicity: held-out accuracy, misspellings, gradients of the sparse sums, and odd inputs."""

import random
import zlib

import numpy as np
import pytest

from fareloom.llm import toxicity

INSULTS = ["idiot", "worthless", "pathetic", "moron"]


def corpus(count, seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghilmnoprstu", k=draw.randint(2, 9))) for _ in range(300)]
    rows = []
    for n in range(count):
        toxic = int(draw.random() < 0.3)
        text = draw.choices(words, k=draw.randint(5, 120))
        for _ in range(toxic * draw.randint(2, 4)):
            text.insert(draw.randint(0, len(text)), draw.choice(INSULTS))
        rows.append((n, " ".join(text).capitalize() + ".", toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(600, 1)
    return toxicity.fit([r[1] for r in rows], np.array([r[2] for r in rows]), np.ones(len(rows)))


def test_held_out_accuracy(model):
    rows = corpus(900, 1)[600:]
    found = model.scores([r[1] for r in rows]) >= toxicity.THRESHOLD
    assert np.mean(found == np.array([r[2] for r in rows])) > 0.95


def test_misspellings_share_vectors(model):
    words = next(t for _, t, toxic in corpus(600, 1) if not toxic and len(t) > 200)
    clean, spelled, wrong = model.scores([words, f"{words} idiot pathetic", f"{words} idiott ppathetic"])
    assert spelled > 0.5 > clean and wrong > 0.5


def test_word_means_by_hand():
    grams = toxicity.Grams([b"ab abc", b"", b"z"], 1 << 10)
    values = np.random.default_rng(1).random(1 << 10)
    words, cells = grams.pairs()
    by_hand = [values[cells[words == w]].mean() if (words == w).any() else 0 for w in range(3)]
    assert np.allclose(grams.word_means(values), by_hand)
    assert np.bincount(words, minlength=3).tolist() == [3, 6, 1]
    assert grams.rows.tolist() == [0, 2, 2, 3]


def test_whole_query(spark):
    rows = corpus(300, 3)
    docs = spark.createDataFrame([(n, t, 1.0) for n, t, _ in rows] + [(None, None, 1.0), (1000, "", 1.0), (1000, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(n, y) for n, _, y in rows] + [(5, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).first().predicted == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0
