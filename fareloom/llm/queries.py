"""The named queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fareloom.llm import byte_bpe, decontaminate, fingerprints, html_text, lexical_search, licenses, line_templates, lm_scores, near_dedup, resampling, secrets, span_dedup, toxicity
from fareloom.llm.common import read_table


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score(read_table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classify(read_table(spark, sf_dir, "documents"))


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove_repeated_spans(read_table(spark, sf_dir, "documents"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.count_recurring_lines(read_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_lm_scores, op2_fingerprints, op3_html_text, op4_toxicity, op5_byte_bpe, op6_decontaminate, op7_near_dedup, op8_span_dedup, op9_line_templates, op10_secrets, op11_licenses, op12_resampling, op13_lexical_search)
    return {query.__name__: query for query in named}


def all_sql() -> dict[str, str]:
    return {
        "op6_decontaminate": decontaminate.SQL,
        "op8_span_dedup": span_dedup.SQL,
        "op9_line_templates": line_templates.SQL,
        "op12_resampling": resampling.SQL,
        "op13_lexical_search": lexical_search.SQL,
    }
