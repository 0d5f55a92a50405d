"""The training-data pipeline: stages over `documents`, each written as Parquet before the next one reads it.

1. toxicity: documents that the classifier rejects go.
2. line dedup: lines of recurring templates go, but for their first occurrence, whatever pivot finds the template; documents stay.
3. near-dedup: one document of each group of near copies stays.
4. decontamination: documents with too many words of benchmark windows go.
5. byte-level BPE: the documents that are left are encoded and decoded.

All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.llm import byte_bpe, decontaminate, line_templates, near_dedup, toxicity
from fareloom.llm import queries as operators
from fareloom.llm.common import read_table, stored

# Models trained here and a tokenizer library decide; SQL can't express them.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring_lines(docs, whole=True)
    changed = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return found.withColumns(changed).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**operators.all_queries(), "pipeline": run}


def all_sql() -> dict[str, str]:
    return operators.all_sql()
