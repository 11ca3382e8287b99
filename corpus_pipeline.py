"""A corpus from raw documents to token records: five stages, each an operator of garimpo.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of documents. NULL texts fail the quality rules. Near-dedup and decontamination judge each row by itself: rows without
doc_id, or with one that others have too, get a number of their own for it. Empty tables and extra columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm import decontaminate, mixing, neardup, records, repetition
from garimpo.llm.common import checkpoint_dir, remove, ship, with_keys, without


#: A column that no table of documents has.
KEY = "garimpo_key"


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(KEY).alias("doc_id"), "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    ship(spark)
    # repetition() leaves out columns with its figures' names: all but the text go by its place, and back by their names
    places = [f"garimpo_{k}" if c != "text" else c for k, c in enumerate(docs.columns)]
    return repetition.repetition(docs.toDF(*places)).where("kept").select(*places).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays (the smallest text, where doc_ids are missing or repeated): five-word shingles, similarity of 0.8 or more."""
    ship(spark)
    rows = with_keys(docs, KEY)
    return without(rows, neardup.near_duplicates(_texts(rows)).where("not kept"), KEY).drop(KEY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    ship(spark)
    rows = with_keys(docs, KEY)
    return without(rows, decontaminate.leaks(_texts(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), KEY).drop(KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records, written and read back: doc_id, start, n_tokens, ids_crc32."""
    return records.token_output(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix), ("token output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, with a written table in the shared folder between them.

    A stage's table goes as soon as the next one is written; the token records and their index stay, as the result is
    read from them.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{checkpoint_dir(spark)}/stage-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
            last = path
        elif last:
            remove(spark, last)
    return docs


#: Tokenisation is beyond SQL; tests hold run() over a whole table against the stages, and these against brute force.
ORACLE_SQL = None
