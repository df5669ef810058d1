"""Quality rules as a bitmask ledger.

Every rule is evaluated once: a scan measures each whole text, one expression turns the measurements
into failure bits, and both are stored. A policy is a versioned mask over those bits, so changing
it, comparing versions or asking what a rule alone costs only reads the ledger's integers again.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_exclaims")


def measure_text(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; nothing in a null or empty one."""
    if not text:
        return (0,) * len(MEASURES)
    words = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often, covered = Counter(windows), 0  # covered: the first word that no window has reached yet
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(map(str.isupper, words)),
        text.count("!"),
    )


@dataclass(frozen=True)
class Rule:
    """A document fails if the expression over MEASURES holds; bit is its place in the ledger, never reused."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "5 * n_symbols > n_words"),
    Rule(3, "shouting", "2 * n_upper_words > n_words"),
    Rule(4, "exclaims", "2 * n_exclaims > n_words"),
    Rule(5, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(6, "long_words", "word_chars > 20 * n_words"),
    Rule(7, "some_symbols", "20 * n_symbols > n_words"),
)
BASE = ("too_few_words", "repeated_windows")
#: Versions of the verdict: the rules that reject.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "shouting", "exclaims", "repeated_lines", "long_words"),
    "strict": tuple(r.name for r in RULES),
}


def mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, MEASURES as long, failures long): one row per input row, measured on the whole text.

    A null text has no words and fails what an empty one fails. Null ids stay, repeated rows are each
    measured, an empty table gives none, other columns are not read. No shuffle.
    """

    def run(batches):
        for batch in text_slices(batches, "text"):
            rows = list(map(measure_text, batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", *MEASURES])

    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, schema)
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")) for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failures", total)


def passes(policy: str, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(kept_ledger: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: rows failing it, rows failing nothing else, and rows kept with the rule left out.

    Works on the distinct bit patterns with their counts, at most two to the number of rules.
    """
    own = mask(policy)
    patterns = kept_ledger.groupBy(F.col("failures").bitwiseAND(F.lit(own).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("one")) for r in RULES if r.name in POLICIES[policy]]
    each = patterns.select("bits", "n", F.explode(F.array(*rules)).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("one"))
    return each.groupBy("bit", "rule").agg(
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("one"), F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("one")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
