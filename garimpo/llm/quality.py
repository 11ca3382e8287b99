"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.common import coded, crc_mod, mix64, rows_of, sliced, split_words, string_hash

BITS = 18
#: The weights are learned from so many labelled documents at most, those whose id has the smallest hash.
TRAIN_DOCS = 6000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.02, 0.1
THRESHOLD = 0.7
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shapes(words: pa.Array) -> pa.Array:
    """Each word with a for lower-case, A for upper-case letters and 0 for digits, runs of one kind shortened to one."""
    out = words
    for kind, to in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lm}\p{Lo}]+", "a"), (r"\p{N}+", "0")):
        out = pc.replace_substring_regex(out, kind, to)
    return out


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, slot and value of each hashed feature: words and shapes of words, each alone and in pairs of neighbours,
    and which of three neighbours are the same word.

    The values of a text have length 1; a text without words has no features.
    """
    offsets, words = split_words(text)
    codes, distinct = coded(words)
    rows, size = rows_of(offsets), len(offsets) - 1
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    shape_codes, shape_kinds = coded(shapes(distinct))
    word = mix64(string_hash(pc.utf8_lower(distinct)))[codes]
    shape = mix64(string_hash(shape_kinds) + _A)[shape_codes][codes]
    pair = rows[:-1] == rows[1:]
    kinds = [(rows, word), (rows, shape)] + [(rows[:-1][pair], mix64(x[:-1] * _A + x[1:] * _B)[pair]) for x in (word, shape)]
    three = rows[:-2] == rows[2:]
    alike = (codes[:-2] == codes[1:-1]) + 2 * (codes[1:-1] == codes[2:]) + 4 * (codes[:-2] == codes[2:])
    kinds.append((rows[:-2][three], mix64(alike[three].astype(np.uint64) + _B)))
    slot = np.concatenate([r << BITS | (mix64(x) >> np.uint64(64 - BITS)).astype(np.int64) for r, x in kinds])
    slot, n = np.unique(slot, return_counts=True)
    row, slot = slot >> BITS, slot & ((1 << BITS) - 1)
    value = np.sqrt(n)
    norm = np.sqrt(np.bincount(row, value * value, size))
    return row, slot, value / norm[row]


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def follow(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal, an update for each example in turn: the weights by slot and the bias."""
    slots = (1 << BITS) + 1  # the last is the bias
    z, n = np.zeros(slots), np.zeros(slots)
    for _ in range(epochs):
        for slot, value, label in examples:
            slot, value = np.append(slot, slots - 1), np.append(value, 1.0)
            w = weights(z[slot], n[slot])
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(n[slot] + g * g) - np.sqrt(n[slot])) / ALPHA
            z[slot] += g - sigma * w
            n[slot] += g * g
    w = weights(z, n)
    return w[:-1].astype(np.float32), float(w[-1])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, quality and the features of each labelled text."""
    for batch in sliced(batches):
        row, slot, value = features(batch.column(2))
        cut = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(cut, pa.array(slot, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(value))], names=["place", "quality", "slots", "values"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All examples meet in one task: there are TRAIN_DOCS at most, each with 2^BITS features at most."""
    found = []
    for batch in batches:
        at, slot, value = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy().astype(np.int64), batch.column(3).values.to_numpy()
        found += [(place, slot[at[i] : at[i + 1]], value[at[i] : at[i + 1]], label) for i, (place, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))]
    found.sort(key=lambda x: x[0])
    w, bias = follow([x[1:] for x in found])
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """Weights and bias from documents with a label of 0 or 1; without any, all scores are 0.5.

    Of several labels or texts of one doc_id the smallest counts. Features are made where the texts are; only the
    sample's features go to the one task that learns.
    """
    named = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = named.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(most)
    # at most ``most`` ids: small enough to send to every executor
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("place", "quality").agg(F.min("text").alias("text"))
    found = rows.mapInArrow(_examples, "place long, quality int, slots array<int>, values array<double>").repartition(1).mapInArrow(_train, "w binary, bias double").collect()
    return (np.frombuffer(found[0]["w"], np.float32), found[0]["bias"]) if found else (np.zeros(1 << BITS, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: list[str] | None = None) -> DataFrame:
    """``key`` columns and score, the chance of label 1, of each row's whole text; NULL and empty texts get the bias's. Extra columns are ignored."""
    key = key or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    use = docs.select(*key, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in use.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for batch in sliced(batches):
            row, slot, value = features(batch.column(batch.schema.get_field_index("text")))
            dot = np.bincount(row, w[slot] * value, batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in key] + [pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], names=[*key, "score"])

    return use.mapInArrow(run, f"{kinds}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_mod: int = 4, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from the labels of documents that aren't held out and score all: doc_id, held_out, score, predicted.

    A row for each row of ``docs``, repeated ones included. NULL and empty texts have the bias's score; an empty table
    gives no row; without labels each score is 0.5. Extra columns of either table are ignored.
    """
    out = crc_mod("doc_id", held_out_mod) == held_out
    found = score(docs.select("doc_id", "text", out.alias("held_out")), learn(docs.where(~out), labels), ["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def auc(frame: pd.DataFrame, score: str = "score", label: str = "quality") -> float:
    """Chance that a row of label 1 has a higher score than a row of label 0."""
    rank = frame[score].rank()
    ones = frame[label] == 1
    n, m = int(ones.sum()), int((~ones).sum())
    return float((rank[ones].sum() - n * (n + 1) / 2) / (n * m))
