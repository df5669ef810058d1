"""The registered queries of this package: each runs its operator over a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuzzy_lines, html_lstm, interp_lm, langid, oracles, packing, pivot_join, rule_ledger, simhash, suffix
from .bpe import encode_documents
from .common import table

POLICY = "v1"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op2_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interp_lm.score(table(spark, sf_dir, "documents"))


def op3_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rule_ledger.passes("base")).alias("base_failed"), rule_ledger.passes(POLICY).alias("kept"), "failures",
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs.where(~fold & F.col("doc_id").isNotNull()))
    return langid.predict(docs, model).select("doc_id", fold.alias("held_out"), "lang_pred", "score")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.passages(table(spark, sf_dir, "documents"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_groups(table(spark, sf_dir, "documents"), wide=fuzzy_lines.WIDE)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), output="digest")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lstm.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_interpolated_lm": op2_interpolated_lm,
        "op3_metric_join": op3_metric_join,
        "op4_quality_rules": op4_quality_rules,
        "op5_language_id": op5_language_id,
        "op6_repeated_passages": op6_repeated_passages,
        "op7_fuzzy_lines": op7_fuzzy_lines,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_packing": op9_packing,
        "op10_html_text": op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: XXH64, learned weights, edit distances, tokenisers and the LSTM are held against brute
    force, round trips and made pages in tests/llm."""
    return {
        "op3_metric_join": oracles.METRIC_JOIN,
        "op4_quality_rules": oracles.quality_rules(POLICY),
        "op6_repeated_passages": oracles.REPEATED_PASSAGES,
    }
