"""The operators applied to whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm import decontaminate, lines, mixing, neardup, ppm, quality, records, repetition, substring, toolcalls
from garimpo.llm.common import table
from garimpo.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.language_id(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toolcalls.link(*toolcalls.from_turns(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "call_id", "level", "place", "status", "valid", "json")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "item_ids")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_output(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.repetition(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_minhash_near_dedup, op3_tool_call_linking, op4_quality_classifier, op5_mixing, op6_line_dedup, op7_decontamination, op8_token_output, op9_substring_dedup, op10_quality_rules)}
