"""Shared pieces of the training-data operators: words, hashes, checkpoints, bounded bitmaps."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six ASCII white-space characters.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python worker handles at once, and that a batch sent to it has at most, but for single texts.
SLICE_BYTES, BATCH_BYTES = 1 << 20, 2 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even if the session was begun elsewhere."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; texts are large rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where none is named, a local master, which is one machine, gets a temporary folder (tests); on a cluster there is an
    error, as its machines share none.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="garimpo-checkpoint-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable copy in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; NULL counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); ``x`` is a uint64 array and is not changed."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def string_hash(strings: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    if not len(strings):
        return np.empty(0, np.uint64)
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False), categorize=False)


def split_words(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than texts) into the words of all texts, and those words; NULL has none."""
    parts = pc.ascii_split_whitespace(text.fill_null(""))
    words, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    if pc.all(full).as_py() is not False:
        return offsets, words
    seen = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return seen[offsets], words.filter(full)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of each word, and the distinct words by code."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and a 64-bit hash of each word."""
    offsets, words = split_words(text)
    codes, distinct = coded(words)
    hashes = string_hash(distinct)
    return offsets, hashes[codes] if len(codes) else np.empty(0, np.uint64)


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of one column; a longer text makes a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        if size[-1] <= most:
            yield batch
            continue
        begin, before = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(size, before + most, "right")))
            piece = batch.slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in piece.columns], schema=piece.schema)
            begin, before = end, int(size[end - 1])
    release()


def release() -> None:
    """Give what this worker no longer uses back to the system: workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's elements."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


#: Bits of a bitmap at least and at most, and for each key: what is broadcast has at most BITS_MOST / 64 rows of 16
#: bytes, whatever the input; a fuller bitmap lets more rows through, never fewer.
BITS_LEAST, BITS_MOST, BITS_EACH = 1 << 16, 1 << 26, 16


class Bitmap:
    """A superset test of a key's values in a bounded number of bits, to keep rows that can't match out of a shuffle.

    The executors build it, 64 bits a row, and it is joined by the number of these rows as a broadcast table.
    """

    def __init__(self, keys: DataFrame, key: str):
        self.size = min(BITS_MOST, max(BITS_LEAST, 1 << (BITS_EACH * keys.count()).bit_length()))
        word, bit = self._place(F.col(key))
        self.words = keys.select(word.alias("garimpo_word"), F.expr("1L").alias("one"), bit.alias("bit")).groupBy("garimpo_word").agg(F.expr("bit_or(shiftleft(one, bit))").alias("garimpo_bits"))

    def _place(self, key: Column) -> tuple[Column, Column]:
        slot = F.pmod(F.xxhash64(key), F.lit(self.size))
        return F.shiftright(slot, 6), (slot % 64).cast("int")

    def mark(self, df: DataFrame, key: str, name: str = "garimpo_maybe") -> DataFrame:
        """``df`` with a boolean column that is true for all rows whose key is held, and for few others."""
        word, bit = self._place(F.col(key))
        met = df.join(F.broadcast(self.words), word == F.col("garimpo_word"), "left")
        return met.withColumn(name, F.coalesce(F.getbit("garimpo_bits", bit) == 1, F.lit(False))).drop("garimpo_word", "garimpo_bits")

    def some(self, df: DataFrame, key: str) -> DataFrame:
        """The rows of ``df`` that may be held."""
        word, bit = self._place(F.col(key))
        return df.join(F.broadcast(self.words), (word == F.col("garimpo_word")) & (F.getbit("garimpo_bits", bit) == 1)).drop("garimpo_word", "garimpo_bits")


def with_keys(docs: DataFrame, name: str = "garimpo_key") -> DataFrame:
    """``docs`` with a number for each row that no other row has: doc_id itself, where every row has one of its own.

    Where doc_ids are missing or repeated, the rows' numbers follow doc_id (NULL last) and text, in a checkpoint.
    """
    ident = F.col("doc_id").cast("long")
    ids = docs.groupBy(ident.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if not ids.where("n > 1 or id is null").limit(1).count():
        return docs.withColumn(name, ident)
    order = [ident.asc_nulls_last(), F.col("text").asc_nulls_last()]
    return checkpoint(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key isn't in ``ids(doc_id)``; only rows that may be in it are shuffled. Rows without key stay."""
    gone = checkpoint(ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("garimpo_gone")).distinct())
    marked = Bitmap(gone, "garimpo_gone").mark(docs.withColumn("garimpo_id", F.col(key).cast("long")), "garimpo_id")
    left = marked.where("garimpo_maybe").join(gone, F.col("garimpo_id") == F.col("garimpo_gone"), "left_anti")
    return marked.where("not garimpo_maybe").unionByName(left).drop("garimpo_id", "garimpo_maybe")
