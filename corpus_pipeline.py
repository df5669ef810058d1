"""From raw documents to packed training sequences: each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.llm import fuzzy_lines, langid, near_texts, packing, suffix
from auralith.llm.common import Tables, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from three quarters of the documents and drops those, of all, that get no language."""
    learned = docs.where(~langid.held_out(F.col("doc_id"), 4, 2) & F.col("doc_id").isNotNull())
    return langid.keep_known(docs, langid.train(learned))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of equal and nearly equal lines; documents left without a word go."""
    return fuzzy_lines.remove_lines(docs, wide=fuzzy_lines.WIDE, least_words=1)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by fingerprints of five-word shingles and a similarity of 0.8."""
    return near_texts.one_of_each(docs, wide=near_texts.WIDE)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of fifty words and more that are kept in another place."""
    return suffix.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]
#: Language scores, SimHash of XXH64, edit distances and tokenisation have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, docs = Tables(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
