"""Substring dedup against brute force."""

import hashlib
import random
import re

import duckdb
import pytest

from fareloom.llm import span_dedup as S


def brute_force(rows):
    """Rows (id, text), different ids: as the contract says."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone.update(range(s, s + 20))
            seen.add(window)
        kept = [w for n, w in enumerate(words) if n not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def documents(seed):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcé", k=4)) for _ in range(draw.choice([6, 60]))]
    passages = [draw.choices(vocabulary, k=draw.randint(15, 120)) for _ in range(6)]
    rows = []
    for n in range(70):
        words = []
        for _ in range(draw.randint(0, 5)):
            if draw.random() < 0.6:
                p = draw.choice(passages)
                a = draw.randint(0, 10)
                words += p[a : len(p) - draw.randint(0, 10)]
            else:
                words += draw.choices(vocabulary, k=draw.randint(1, 40))
            if words and draw.random() < 0.3:
                words[draw.randrange(len(words))] = "edit"
        rows.append((n * 2 - 30, draw.choice([" ", "  ", "\n", "\t\x0b"]).join(words)))
    rows += [(500, None), (501, ""), (502, "word " * 200), (503, "a b " * 100), (504, "a\x85b c " * 30), (505, rows[3][1]), (None, rows[5][1])]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_brute_force(spark, seed):
    rows = documents(seed)
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, copy int").repartition(3)
    found = sorted((tuple(r) for r in S.remove_repeated_spans(df).collect()), key=repr)
    assert found == sorted(brute_force(rows), key=repr)
    assert sum(r[2] for r in found) > 500


def test_sql_with_repeated_rows_and_null_ids(spark):
    """Repeated rows are one document and a row without id comes first, in SQL as well."""
    rows = documents(5)
    rows += [rows[4], rows[4], (None, rows[6][1]), (None, rows[6][1])]
    rows = [r for r in rows if r[0] is not None or r[1] == rows[-1][1]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    found = sorted((tuple(r) for r in S.remove_repeated_spans(df).collect()), key=repr)
    assert found == sorted(con.sql(S.SQL).fetchall(), key=repr)


def test_long_text_and_passage_of_a_third(spark):
    """A text of 200,000 words that repeats its half, and one passage in a third of 600 documents."""
    draw = random.Random(7)
    half = " ".join(f"w{draw.randrange(10**6)}" for _ in range(100_000))
    passage = " ".join(f"p{n}" for n in range(60))
    rows = [(n, f"only{n} {passage} end{n}" if n % 3 == 0 else f"alone{n}") for n in range(600)]
    found = {r.doc_id: r for r in S.remove_repeated_spans(spark.createDataFrame([*rows, (1000, f"{half} {half}")], "doc_id long, text string")).collect()}
    assert (found[1000].n_words, found[1000].n_removed) == (200_000, 100_000)
    assert found[0].n_removed == 0 and all(found[n].n_removed == 60 for n in range(3, 600, 3))


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in S.remove_repeated_spans(df).collect()) == [0, 0, 50]
    assert S.remove_repeated_spans(df.limit(0)).count() == 0
