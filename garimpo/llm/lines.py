"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.common import Bitmap, checkpoint, coded, mix64, rows_of, sliced, string_hash

LINES = 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def line_windows(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first line and two hashes of each window of LINES lines that has a word."""
    parts = pc.split_pattern(text.fill_null(""), "\n")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    codes, distinct = coded(parts.flatten())
    rows = rows_of(offsets)
    if len(codes) < LINES:
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    h = mix64(string_hash(distinct) + _A)[codes]
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(distinct)), 0).to_numpy(zero_copy_only=False).astype(bool)[codes]
    n = len(codes) - LINES + 1
    k1, k2, some = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
    for j in range(LINES):
        k1, k2 = mix64(k1 * _B + h[j : n + j]), mix64((k2 + h[j : n + j]) * _A)
        some |= full[j : n + j]
    at = np.flatnonzero((rows[:n] == rows[LINES - 1 :]) & some)
    return rows[at], at - offsets[rows[at]], k1[at], k2[at]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        row, line, k1, k2 = line_windows(batch.column(2))
        again = np.ones(len(row), bool)
        again[np.unique(mix64(k1 + row.astype(np.uint64) * _A) ^ k2, return_index=True)[1]] = False
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(line, pa.int32()), pa.array(again), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], names=["doc_id", "th", "line", "again", "k1", "k2"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        total, removed, kept = [], [], []
        found = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for text, begins in zip(batch.column(1).fill_null("").to_pylist(), found, strict=True):
            lines = text.split("\n")
            total.append(len(lines))
            gone = {b + j for b in begins or () for j in range(LINES)}
            removed.append(len(gone))
            kept.append("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_text"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_text of each row of ``docs``.

    A window is LINES consecutive lines of one text, as they stand, with a word in one of them. Its first place is the
    smallest doc_id and there the first line; at every other place its lines are removed, where the covered lines of
    overlapping windows merge. NULL counts as the empty text, which is one empty line. A row without doc_id loses only
    what it repeats itself; rows that share a doc_id aren't compared with each other. Extra columns are ignored.
    """
    use = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    found = use.mapInArrow(_windows, "doc_id long, th long, line int, again boolean, k1 long, k2 long")
    firsts = found.where("doc_id is not null and not again").groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc")
    firsts = checkpoint(firsts)  # a join of two plain shuffles is one that Spark splits where a window is hot
    across = found.where("doc_id is not null and not again").join(firsts, ["k1", "k2"]).where("doc_id > first_doc")
    late = found.where("again").select("doc_id", "th", "line").unionByName(across.select("doc_id", "th", "line"))
    begins = checkpoint(late.groupBy("doc_id", "th").agg(F.collect_set("line").alias("begins")))
    held = Bitmap(begins, "th").mark(use, "th", "maybe")
    schema = "doc_id long, n_lines long, n_removed long, kept_text string"
    rest = held.where("not maybe").select("doc_id", "text").mapInArrow(_keep, schema)
    met = held.where("maybe").alias("d").join(begins.alias("b"), F.expr("d.doc_id <=> b.doc_id AND d.th = b.th"), "left").select("d.doc_id", "text", "begins").mapInArrow(_keep, schema)
    return rest.unionByName(met)
