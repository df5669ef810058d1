"""Taggers: each gives an array of (name, normalized_name, source, confidence) per row, first occurrence first."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auralith.functions.exprs import distinct_first, normalize_name
from auralith.functions.rules import RuleError, compile_rule
from auralith.operators.blocks import block_join, matrix
from auralith.operators.similarity import best_rows, first_copies

# fixed values: path words that say nothing, numbers that do, metadata keys in order, default labels, prompt lines
PATH_STOP_WORDS = "audio clip clips file files fx hit hits library loop loops one pack sample samples shot shots sound sounds stem stems track tracks".split()
PATH_NUMBERS = ["606", "707", "808", "909"]
METADATA_KEYS = ["embedded.genre", "embedded.artist", "embedded.album_artist", "embedded.composer", "embedded.album", "embedded.title", "embedded.comment"]
DEFAULT_LABELS = ["bass", "bell", "clap", "drone", "glitch", "hi hat", "impact", "kick", "lead", "metallic", "pad", "percussive", "pluck", "snare", "sub bass", "sweep", "vocal chop"]
PROMPT_HEAD = ["Suggest descriptive tags for this audio sample.", "Prefer mood, genre, texture, and instrument/use labels."]
SYSTEM_PROMPT = "You label audio samples. Return only a comma-separated list of short lowercase tags describing vibe, genre, texture, or use. Do not explain."
LLM_LIMIT, LLM_CONFIDENCE, LLM_TEMPERATURE = 8, 0.75, 0.2
CLAP_FLOOR, CLAP_LIMIT, CLAP_SLACK = 0.32, 3, 0.05
KNN_K, KNN_LIMIT, KNN_FLOOR = 3, 5, 0.34
RULE_CONFIDENCE, RULE_SOURCE = 0.7, "rules"


def _tags(names: Column, source: str, confidence: float) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), n.alias("normalized_name"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))


def path_names(relative_path: Column, path: Column) -> Column:
    """Useful words of the path's segments, extensions cut off every segment."""
    chosen = F.when(F.trim(F.coalesce(relative_path, F.lit(""))) == "", path).otherwise(relative_path)

    def words(segment):
        bare = F.replace(F.regexp_replace(F.trim(segment), r"\.[^.]*$", ""), F.lit("+"), F.lit(" "))
        decoded = F.coalesce(F.try_url_decode(bare), bare)
        return F.split(F.regexp_replace(decoded, r"[_\-.()\[\]{}]", " "), r"\s+")

    names = F.transform(F.flatten(F.transform(F.split(chosen, "/"), words)), normalize_name)
    useful = F.filter(names, lambda n: (F.octet_length(n) >= 2) & ~n.isin(PATH_STOP_WORDS) & (~n.rlike(r"^\p{Nd}+$") | n.isin(PATH_NUMBERS)))
    return distinct_first(useful)


def path_tags(relative_path: Column, path: Column) -> Column:
    return _tags(path_names(relative_path, path), "path", 1.0)


def metadata_names(attributes: Column) -> Column:
    parts = F.flatten(F.array(*[F.split(F.coalesce(F.try_element_at(attributes, F.lit(k)), F.lit("")), r"[,;/|]") for k in METADATA_KEYS]))
    return distinct_first(F.transform(parts, normalize_name))


def metadata_tags(attributes: Column) -> Column:
    return _tags(metadata_names(attributes), "metadata", 1.0)


def read_rules(text: str) -> list[dict]:
    """{"rules": [...]} with at least one rule, or a bare list."""
    data = json.loads(text)
    if isinstance(data, dict):
        data = data.get("rules") or []
    if not isinstance(data, list):
        raise RuleError("rules must be a list")
    return data


def rule_tags(rules: list[dict]) -> Column:
    """One expression for all rules over a table with sample columns, metrics and attributes."""
    found, taken = [], F.lit(None)
    seen: dict[str, Column] = {}
    for rule in rules:
        name = " ".join(rule.get("tag", "").lower().replace("_", " ").replace("-", " ").split())
        if not name:
            raise RuleError("rule tag is required")
        holds = compile_rule(rule.get("expr", ""))
        confidence = rule.get("confidence") or 0
        source = (rule.get("source") or "").strip() and rule["source"] or RULE_SOURCE
        first = holds & ~seen[name] if name in seen else holds
        seen[name] = seen[name] | holds if name in seen else holds
        tag = F.struct(F.lit(name).alias("name"), F.lit(name).alias("normalized_name"), F.lit(source).alias("source"), F.lit(float(confidence if confidence > 0 else RULE_CONFIDENCE)).alias("confidence"))
        found.append(F.when(first, tag))
    return F.array_compact(F.array(*found)) if found else F.array(taken)


def merge_tags(*arrays: Column) -> Column:
    """Arrays of tags one after another, each normalized name at its first place."""
    every = F.filter(F.flatten(F.array(*arrays)), lambda t: t["normalized_name"] != "")
    return F.filter(every, lambda t, k: F.array_position(F.transform(every, lambda u: u["normalized_name"]), t["normalized_name"]) == k + 1)


def knn_tags(queries: DataFrame, examples: DataFrame, k: int = KNN_K, limit: int = KNN_LIMIT, floor: float = KNN_FLOOR) -> DataFrame:
    """(sample_id, tag, score, rank) from examples (sample_id, values, tags): each of the k nearest examples weighs
    1 / (1 + distance); a tag scores its share of the weight, and those of at least the floor stay, best first."""
    k, limit, floor = k if k > 0 else KNN_K, limit if limit > 0 else KNN_LIMIT, floor if floor > 0 else KNN_FLOOR

    def solve(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(x["values"]), matrix(y["values"])
        examples_ids = y["sample_id"].to_numpy()
        usable = np.broadcast_to(first_copies(b, examples_ids, k), (len(a), len(b)))
        i, j, weight, _ = best_rows(a, b, usable, examples_ids, k, "euclidean")
        return pd.DataFrame({"query": x["sample_id"].to_numpy()[i], "example": examples_ids[j], "weight": weight, "tags": y["tags"].to_numpy()[j]})

    found = block_join(queries.select("sample_id", "values"), examples.select("sample_id", "values", "tags"), "sample_id", solve, "query long, example long, weight double, tags array<string>")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), "example"))).where(F.col("r") <= k)
    total = best.groupBy("query").agg(F.sum("weight").alias("total"))
    votes = best.select("query", "weight", F.explode(F.array_distinct(F.transform("tags", normalize_name))).alias("tag")).where("tag <> ''")
    scores = votes.groupBy("query", "tag").agg(F.sum("weight").alias("w")).join(total, "query").select(F.col("query").alias("sample_id"), "tag", (F.col("w") / F.col("total")).alias("score"))
    ranked = scores.where(F.col("score") >= floor).withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("score"), "tag")))
    return ranked.where(F.col("rank") <= limit)


def clap_names(scores: Column, defaults: bool = True, floor: float = CLAP_FLOOR, limit: int = CLAP_LIMIT) -> Column:
    """From an array of (label, score): the best labels, at least the floor and, with default labels, within the slack of the best."""
    ranked = F.array_sort(scores, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))
    least = F.greatest(F.lit(floor), F.get(ranked, F.lit(0))["score"] - CLAP_SLACK) if defaults else F.lit(floor)
    named = F.filter(ranked, lambda s: (s["score"] >= least) & (normalize_name(s["label"]) != ""))
    return F.transform(F.slice(named, 1, limit), lambda s: normalize_name(s["label"]))


def clap_tags(scores: Column, defaults: bool = True, floor: float = CLAP_FLOOR, limit: int = CLAP_LIMIT) -> Column:
    """The best labels as tags, each with its score as confidence."""
    named = F.transform(clap_names(scores, defaults, floor, limit), lambda n: F.struct(n.alias("name"), F.array_max(F.transform(F.filter(scores, lambda s: normalize_name(s["label"]) == n), lambda s: s["score"].cast("double"))).alias("confidence")))
    return F.transform(named, lambda t: F.struct(t["name"].alias("name"), t["name"].alias("normalized_name"), F.lit("clap").alias("source"), t["confidence"].alias("confidence")))


def llm_prompt(path: Column, file_name: Column, tags: Column, attributes: Column, metrics: Column) -> Column:
    """The user message: fixed lines, path, file name, sorted tags, attributes and metrics."""
    head = [F.lit(x) for x in PROMPT_HEAD] + [F.concat(F.lit("path: "), path), F.concat(F.lit("filename: "), file_name)]
    existing = F.when(F.size(tags) > 0, F.concat(F.lit("existing_tags: "), F.array_join(F.array_sort(tags), ", ")))
    named = F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(F.lit("attribute."), e["key"], F.lit(": "), e["value"]))
    measured = F.transform(F.array_sort(F.map_entries(metrics)), lambda e: F.concat(F.lit("metric."), e["key"], F.lit(": "), F.format_string("%.6f", e["value"])))
    return F.array_join(F.concat(F.array_compact(F.array(*head, existing)), named, measured), "\n")


def llm_names(reply: Column, limit: int = LLM_LIMIT) -> Column:
    """Tags of a reply: brackets off, cut at commas, semicolons and line ends, quotes off, normalized, distinct, capped."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^\[", ""), r"\]$", "")
    parts = F.transform(F.split(bare, r"[,\n;]"), lambda p: normalize_name(F.regexp_replace(p, r"""^["']+|["']+$""", "")))
    return F.slice(distinct_first(parts), 1, limit)


def llm_tags(df: DataFrame, prompt_col: str, client: Callable[[dict], str], model: str, limit: int = LLM_LIMIT) -> DataFrame:
    """Adds tags: client(request) gets a chat request as a dict and returns the reply's text; it runs on the executors."""
    if not model.strip():
        raise ValueError("model is required")

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: client({"model": model, "messages": [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": p}], "temperature": LLM_TEMPERATURE}))

    return df.withColumn("tags", _tags(llm_names(ask(F.col(prompt_col)), limit), "llm", LLM_CONFIDENCE))
