"""Stupid-backoff scores against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fareloom.llm import lm_scores as L


def brute_force(rows, alpha=L.ALPHA):
    lists = [(t or "").split() for _, t in rows]
    single = Counter(w for words in lists for w in words)
    total = sum(single.values())
    seen = Counter(p for words in lists for p in zip(["<s>", *words], words))
    single["<s>"] = sum(map(bool, lists))
    out = []
    for (i, _), words in zip(rows, lists, strict=True):
        value, own = 0.0, Counter(words) + Counter({"<s>": bool(words)})
        for (v, w), n in Counter(zip(["<s>", *words], words)).items():
            others = seen[v, w] - n
            share = others / (single[v] - own[v]) if others else alpha * max(single[w] - own[w], 1) / max(total - len(words), 1)
            value += n * math.log(share)
        out.append((i, len(words), value))
    return out


def same(found, wanted, tolerance=1e-5):
    found, wanted = (sorted(x, key=lambda r: (r[0] is None, r)) for x in (found, wanted))
    assert [f[:2] for f in found] == [w[:2] for w in wanted]
    assert [f[2] for f in found] == pytest.approx([w[2] for w in wanted], abs=tolerance)


def scored(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, row string, first int")
    return [(r.doc_id, r.n_words, r.log_score) for r in L.score(df).collect()]


@pytest.mark.parametrize("frequent, bits", [(0, L.BITS), (7, 2), (L.FREQUENT, L.BITS)])
def test_brute_force(spark, monkeypatch, frequent, bits):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    monkeypatch.setattr(L, "BITS", bits)
    draw = random.Random(frequent)
    words = ["".join(draw.choices("abcdé", k=draw.randint(1, 3))) for _ in range(60)]
    rows = [(n, draw.choice([" ", "\n"]).join(draw.choices(words[: draw.randint(2, 60)], k=draw.randint(0, 80)))) for n in range(50)]
    rows += [(100, None), (101, ""), (102, " \n"), (3, rows[3][1]), (None, "a b"), (None, "a b c"), (103, "a " * 3000), (104, "own words own words here"), (104, "again a b again")]
    same(scored(spark, rows), brute_force(rows))


def test_no_word_is_folded(spark):
    """More words of one count than any bounded vocabulary."""
    words = [f"w{n}" for n in range(70_000)]
    turned = " ".join(w for at in range(0, 70_000, 7) for w in reversed(words[at : at + 7]))
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, turned), (4, turned)]
    same(scored(spark, rows), brute_force(rows), 1e-3)


def test_backs_off_without_its_own_counts(spark):
    """A pair that only one document has backs off however often it has it; copies speak for each other."""
    rows = [(1, "p q p q p q"), (2, "x y"), (3, "x y"), (4, "x y x y")]
    found = {i: s for i, _, s in scored(spark, rows)}
    # Of 14 words 6 are its own, and nobody else has p or q.
    assert found[1] == pytest.approx(6 * math.log(0.4 / 8), abs=1e-5)
    # <s> x: two of the three other documents; x y: three of three other x.
    assert found[2] == pytest.approx(math.log(2 / 3) + math.log(3 / 3), abs=1e-5)


def test_prose_before_junk(spark):
    """Texts of common words score above a text of words that occur nowhere else, however often it repeats them."""
    draw = random.Random(2)
    common = "the of and to a in is it that was".split()
    rows = [(n, " ".join(draw.choices(common, k=60))) for n in range(40)]
    junk = ["".join(draw.choices("qxzjkvw", k=9)) for _ in range(60)]
    rows += [(100, " ".join(junk)), (101, " ".join([f"{w}{w}" for w in junk[:6]] * 10))]
    means = {i: s / n for i, n, s in scored(spark, rows)}
    assert min(means[n] for n in range(40)) > max(means[100], means[101]) + 1


def test_empty_table(spark):
    assert L.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_slice_gives_each_pair_once():
    """Pairs of several documents of a slice are added up before they are shuffled."""
    texts = ["a b a b", "a b c", None, "", "c"]
    first, second, n, documents = L.slice_pairs(pa.array(texts))
    lists = [(t or "").split() for t in texts]
    pairs = [Counter(zip(["<s>", *words], words)) for words in lists]
    wanted = sum(pairs, Counter())
    assert len({*zip(first.tolist(), second.tolist())}) == len(first) == len(wanted)
    assert sorted(zip(n.tolist(), documents.tolist())) == sorted((wanted[p], sum(p in own for own in pairs)) for p in wanted)
    assert all(len(x) == 0 for x in L.slice_pairs(pa.array([None, ""], pa.string())))


def test_a_task_gives_each_pair_of_a_bucket_once():
    """Pairs of several slices are added up and dealt out by their hash, a row for each bucket."""
    slices = [L.slice_pairs(pa.array(texts)) for texts in (["a b a b", "a b c"], [None, ""], ["c", "a b c d e f"])]
    for bits in (0, 3):
        rows = L._dealt(slices, 63 - bits).to_pylist()
        assert len({r["bucket"] for r in rows}) == len(rows) and all(0 <= r["bucket"] < 1 << bits for r in rows)
        assert bits == 0 or len(rows) > 1
        found = {}
        for row in rows:
            pairs, counts = np.frombuffer(row["pairs"], np.uint64).reshape(2, -1), np.frombuffer(row["counts"], np.int32).reshape(2, -1)
            assert {int(h) >> 64 - bits for h in L.pair_hash(*pairs)} == {row["bucket"]}
            found |= dict(zip(zip(*pairs.tolist()), zip(*counts.tolist()), strict=True))
        wanted = Counter()
        documents = Counter()
        for first, second, n, docs in slices:
            for pair, x, y in zip(zip(first.tolist(), second.tolist()), n.tolist(), docs.tolist()):
                wanted[pair] += x
                documents[pair] += y
        assert found == {p: (wanted[p], documents[p]) for p in wanted}


def test_pairs_of_many_buckets(spark, monkeypatch):
    """A task that deals out often, and more buckets than tasks, change nothing."""
    monkeypatch.setattr(L, "BUCKET_WORDS", 40)
    draw = random.Random(8)
    rows = [(n, " ".join(draw.choices("abcdefghij", k=draw.randint(0, 60)))) for n in range(60)]
    same(scored(spark, rows), brute_force(rows))


def test_pairs_of_held_words_are_codes(spark, monkeypatch):
    """Pairs of held words take half the bytes, whatever share of the words is held; all pairs have the same counts."""
    texts = [f"a b {'xyz'[n % 3]} a b c{n % 5} d{n}" for n in range(20)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    counts = L.word_counts(docs).cache()
    total, begun = sum(len((t or "").split()) for t in texts), 20
    found = []
    for most in (0, 3, 1000):
        words = L.Frequent(counts.where("word <> 0"), "word", ("n",), most)
        found.append(sorted(map(tuple, L.pair_table(docs, counts, total, words, begun).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 10
    key = np.arange(1000, dtype=np.uint64) << np.uint64(32) | np.arange(1000, dtype=np.uint64)[::-1]
    one = np.ones(1000, np.int32)
    row = L._dealt_codes([(key, one, one), (key[:10], one[:10], one[:10])], 63).to_pylist()[0]
    assert len(row["pairs"]) == 8 * 1000
    assert sorted(L._from_planes(row["pairs"], np.uint64).tolist()) == sorted(key.tolist())
    assert L._from_planes(row["counts"], np.int32).sum() == 2 * 1010


@pytest.mark.parametrize("frequent", [0, 3, L.FREQUENT])
def test_documents_meet_once_whatever_is_hot(spark, monkeypatch, frequent):
    """Pairs of hot words, of held ones and of others give the same scores in many buckets, and hot pairs do not leave their bundle."""
    monkeypatch.setattr(L, "BUCKET_WORDS", 60)
    monkeypatch.setattr(L, "FREQUENT", frequent)
    monkeypatch.setattr(L, "HOT", 3)
    draw = random.Random(9)
    rows = [(n, " ".join(draw.choices("abcdefghijklmnop", [9, 9, 9, 5, *[1] * 12], k=draw.randint(0, 60)))) for n in range(60)]
    same(scored(spark, rows), brute_force(rows))
    docs = spark.createDataFrame(rows, "row long, text string")
    counts = L.word_counts(docs).cache()
    meeting = L.Meeting(L.Frequent(counts.where("word <> 0"), "word", ("n",), 2 * frequent), sum(len(t.split()) for _, t in rows), 60)
    kinds = {r.kind: r.n for r in meeting.deal(docs).groupBy("kind").agg(L.F.count("*").alias("n")).collect()}
    assert (L.Meeting.HOT_PAIRS in kinds) == (frequent > 0) and meeting.hot.sum() <= 3 and meeting.buckets > 10


def test_packed_columns():
    """Columns come back as they were, in planes of any width, and small numbers take few bytes."""
    columns = [np.array([0, 1, 2**64 - 1], np.uint64), np.array([3, 2, 1], np.int32), np.array([-1.5, 0.0, 1e300]), np.zeros(3, np.int64)]
    for bits in (2, 8):
        found = L._unpack(L._pack(bits, *columns))
        assert found[0].tolist() == columns[0].tolist() and found[1].tolist() == [3, 2, 1]
        assert found[2].view(np.float64).tolist() == columns[2].tolist() and found[3].tolist() == [0, 0, 0]
    assert L._unpack(L._pack(8, np.zeros(0, np.uint64)))[0].tolist() == []
    assert len(L._pack(8, np.ones(100_000, np.int64))) < 1000
    for half in (1, 4, 20):
        keys = np.unique(np.random.default_rng(half).integers(0, 1 << 2 * half, 1000).astype(np.uint64))
        spread = L._spread(keys, half)
        assert L._gathered(spread, half).tolist() == keys.tolist() and len(np.unique(spread)) == len(keys) and int(spread.max()) < 1 << 2 * half
