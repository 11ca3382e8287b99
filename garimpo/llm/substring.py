"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of each window of WINDOW words, the GRAM words in it with the smallest hash. Equal windows
have equal anchors, so windows are compared only where documents meet at an anchor. A run is a maximal stretch of a
document whose windows share an anchor; runs are compared as wholes first, and a run that an earlier document has
whole is removed whole. Only where documents meet at an anchor with different runs (the edges of a repeat) are their
first copies extended window by window. Merged, the windows are the maximal repeats. No pairs are made: a group of
equal runs or windows is compared with the smallest doc_id that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.common import Bitmap, checkpoint, mix64, rows_of, sliced, word_hashes

WINDOW, GRAM = 50, 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _spans(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` elements from each place on."""
    size = 1
    while 2 * size <= width:
        h = mix64(h[:-size] * _A + h[size:] * _B)
        size *= 2
    rest = width - size
    return mix64(h[: len(h) - rest] * _A + h[rest:] * _B + np.uint64(rest)) if rest else h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the ``width`` elements from each place on."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def windows(offsets: np.ndarray, h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first word, hash and anchor of each window that lies in one text."""
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    rows = rows_of(offsets)
    at = np.flatnonzero(rows[: len(h) - window + 1] == rows[window - 1 :])
    return at, _spans(h, window)[at], _least(_spans(h, gram), window - gram + 1)[at]


def runs(offsets: np.ndarray, h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, place of the first window in the row, windows, anchor and hash of each run."""
    at, key, anchor = windows(offsets, h, window, gram)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (anchor[1:] != anchor[:-1]))))
    size = np.diff(np.append(first, len(at)))
    step = np.arange(len(at)) - np.repeat(first, size)
    power = np.full(int(size.max()), _A)
    power[0] = np.uint64(1)
    power = np.multiply.accumulate(power)
    whole = mix64(np.add.reduceat(key * power[step], first) + size.astype(np.uint64) * _B)
    row = np.searchsorted(offsets, at[first], "right") - 1
    return row, at[first] - offsets[row], size, anchor[first].view(np.int64), whole.view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        row, lo, n, anchor, whole = runs(*word_hashes(batch.column(2)))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(anchor), pa.array(whole)], names=["doc_id", "th", "lo", "n", "anchor", "whole"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the runs that are named in ``spans``."""
    for batch in sliced(batches):
        offsets, h = word_hashes(batch.column(2))
        at, key, anchor = windows(offsets, h)
        listed = batch.column(3)
        row = rows_of(listed.offsets.to_numpy().astype(np.int64))
        spans = listed.flatten()
        lo, n = (spans.field(k).to_numpy().astype(np.int64) for k in range(2))
        first = np.searchsorted(at, offsets[row] + lo)
        pick = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(row, n)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at[pick] - offsets[row], pa.int32()), pa.array(anchor[pick].view(np.int64)), pa.array(key[pick].view(np.int64))], names=["doc_id", "th", "lo", "anchor", "whole"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the words that its spans (first window, windows) cover."""
    for batch in sliced(batches):
        total, removed, kept = [], [], []
        spans = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for text, found in zip(batch.column(1).fill_null("").cast(pa.binary()).to_pylist(), spans, strict=True):
            words = text.split()  # bytes split at the six ASCII white-space characters
            total.append(len(words))
            if found:
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, [s["lo"] for s in found], 1)
                np.add.at(edge, [s["lo"] + s["n"] + WINDOW - 1 for s in found], -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def _firsts(found: DataFrame) -> DataFrame:
    """The smallest doc_id of each (anchor, whole) that several documents have."""
    return checkpoint(found.groupBy("anchor", "whole").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and spans (first window, windows) of the windows that a smaller doc_id has too."""
    use = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    found = use.mapInArrow(_runs, "doc_id long, th long, lo int, n int, anchor long, whole long")
    # what stands on a join's other side is written first: joins of two plain shuffles are those that Spark splits where a key is hot
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).where("first_doc < last_doc").select("anchor", "first_doc", (F.col("w0") != F.col("w1")).alias("edged"))
    met = checkpoint(found.join(checkpoint(shared), "anchor").where("edged or doc_id > first_doc"))

    edged = met.where("edged").drop("first_doc", "edged")
    edged = checkpoint(edged.join(_firsts(edged), ["anchor", "whole"], "left").withColumn("first_doc", F.coalesce("first_doc", "doc_id")))
    open_runs = edged.where("doc_id = first_doc").groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    single = checkpoint(Bitmap(open_runs, "doc_id").some(use, "doc_id").join(open_runs, ["doc_id", "th"]).mapInArrow(_edges, "doc_id long, th long, lo int, anchor long, whole long"))
    late = single.join(_firsts(single), ["anchor", "whole"]).where("doc_id > first_doc").select("doc_id", "th", "lo", F.lit(1).alias("n"))

    whole = [x.where("doc_id > first_doc").select("doc_id", "th", "lo", "n") for x in (met.where("not edged"), edged)]
    return whole[0].unionByName(whole[1]).unionByName(late).groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of each row of ``docs``.

    A word is removed if a window of WINDOW words that covers it is also in a document with a smaller doc_id. NULL
    and empty texts have no words; a row with a NULL doc_id loses nothing and no other row loses words for it; rows
    that share a doc_id aren't compared with each other. Extra columns are ignored.
    """
    found = checkpoint(repeats(docs))
    use = Bitmap(found, "doc_id").mark(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "maybe")
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    rest = use.where("not maybe").select("doc_id", "text").mapInArrow(_keep, schema)
    met = use.where("maybe").select("doc_id", "text", F.xxhash64("text").alias("th")).join(found, ["doc_id", "th"], "left").select("doc_id", "text", "spans").mapInArrow(_keep, schema)
    return rest.unionByName(met)
