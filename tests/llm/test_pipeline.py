"""The pipeline, stage by stage: each decision against brute force on the stage's own input."""

import hashlib
import os

import public_tokenizers
import pytest

import corpus_pipeline
from fareloom.llm import byte_bpe, line_templates, toxicity
from test_decontaminate import expected
from test_near_dedup import brute_force

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_stages(spark, monkeypatch):
    import tiktoken

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = [(str(r[0]), r[1]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    monkeypatch.setattr("test_decontaminate.ITEMS", benchmark)
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append((name, docs, {r.doc_id: r.text for r in docs.collect()}))
        docs = stage(spark, docs, FOLDER).cache()
        assert name == "byte_bpe" or docs.columns == columns
    texts = {name: found for name, _, found in inputs}

    model = toxicity.train(inputs[0][1], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scored = {r.doc_id: r.predicted for r in toxicity.score(inputs[0][1], model).collect()}
    assert set(texts["line_dedup"]) == {i for i, p in scored.items() if not p}

    assert set(texts["near_dedup"]) == set(texts["line_dedup"])
    wanted = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(inputs[1][1]).collect()}
    assert texts["near_dedup"] == wanted
    assert all(r.n_chars == len(r.text) for r in inputs[2][1].collect())

    rows = sorted(texts["near_dedup"].items())
    roots = brute_force(rows)
    first = {}
    for (i, _), root in zip(rows, roots, strict=True):
        first.setdefault(root, i)
    assert set(texts["decontamination"]) == set(first.values())

    clean = {i for i, t in texts["decontamination"].items() if not expected(t)[4]}
    assert set(texts["byte_bpe"]) == clean

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in docs.collect():
        ids = reference.encode_ordinary(texts["byte_bpe"][r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert {r.doc_id for r in docs.collect()} == clean
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, docs.collect()))


PROSE = [" ".join(f"{'abcdefghij'[n % 10]}{'klmnopqrst'[m % 10]}{'uvwxyz'[(n * m) % 6]}{'abcdefgh'[m % 8]}{'ijklmnop'[m // 8]}" for m in range(1, 41)) for n in range(1, 13)]


def hostile(spark, folder, rows):
    """Tables with nulls in any column, repeated rows, and further columns whose names the operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, row long, whole string, n_lines long, gone int, `a b` string"
    made = [(i, t, None, "s", None if t is None else len(t), "x", 7, None, 77, None, "y") for i, t in rows]
    spark.createDataFrame(made, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b", " ".join(PROSE[11].split()[:20])), (None, "x"), ("n", None), ("e", "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_hostile_rows_come_through(spark, tmp_path):
    near = PROSE[0] + " more"
    rows = [(None, None), (None, ""), (None, PROSE[1]), (None, PROSE[2]), (5, PROSE[3]), (5, PROSE[3]), (5, PROSE[4]), (6, ""), (7, None), (8, "\n \n"), (9, PROSE[0]), (10, near), (11, PROSE[11]), (12, PROSE[5] * 200)]
    folder = hostile(spark, str(tmp_path), rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
        assert all(r.n_lines == 77 and r["a b"] == "y" and r.id == "x" for r in docs.collect())
    assert len(seen["toxicity"]) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(seen["line_dedup"], key=key) == sorted(rows, key=key)
    # Null texts stay; of empty texts, of repeated rows and of the near copies one each.
    texts = [t for _, t in seen["near_dedup"]]
    assert texts.count(None) == 2 and texts.count(PROSE[3]) == 1 and (PROSE[0] in texts) != (near in texts)
    assert {PROSE[n] for n in (1, 2, 4, 11)} <= set(texts)
    assert [t for _, t in seen["decontamination"]].count(PROSE[11]) == 0
    assert len(seen["decontamination"]) == len(seen["near_dedup"]) - 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == len(seen["decontamination"])


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, hostile(spark, str(tmp_path), [])).count() == 0


def test_lines_of_every_template_of_a_leaf_go(spark):
    """Eight templates whose lines begin with the same words and are as long: the stage keeps one line of each."""
    kinds = ["about", "against", "after", "before", "beside", "despite", "inside", "under"]
    rows = [(100 * k + n, f"{PROSE[k]}\nShare this story {kind} {'abcdefghijklmnopqrst'[n] * (k + 3)} on {kind}day at {kind}noon") for k, kind in enumerate(kinds) for n in range(18 - k)]
    found = corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()
    assert sorted(r.doc_id for r in found if "Share this story" in r.text) == [100 * k for k in range(8)]


def test_lines_with_the_pivot_of_no_template_have_another(spark):
    """The commonest run stands in lines that share too little for a template, and in those of a template that another run finds."""
    letter = "abcdefghijklmnopqrstuvwxyzABCD"
    shared = ["one", "two", "three", "four", "five", "six", "seven"]
    loose = [[shared[j] if (j - m) % 7 < 4 else f"q{letter[m]}{letter[j]}" for j in range(7)] for m in range(30)]
    kept = [[f"own{letter[n]}", "bake", "cook", "dine", "eat", "feast", "grill"] for n in range(12)]
    rows = [(100 + m, f"{letter[m] * 7}\nShare this story {' '.join(words)} pivot") for m, words in enumerate(loose)]
    rows += [(n, f"{letter[n] * 9}\nShare this story {' '.join(words)} pivot") for n, words in enumerate(kept)]
    found = corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()
    assert sorted(r.doc_id for r in found if "Share" in r.text) == [0, *range(100, 130)]
