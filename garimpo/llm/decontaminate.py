"""Benchmark decontamination by containment: no window that has enough of a passage is left out.

1. Benchmark texts are cut into passages; a term is a word in lower case without other characters than letters and
   digits, and has one of SLOTS slots by its hash. Document frequencies of the slots come from all documents.
2. For every window of every document and each passage, PASSAGES at a time, a bound on the weight (squared idf) of the
   passage's terms that the window has; pairs that may reach PARAPHRASE of the passage's weight are candidates. What
   else stands in the window, and how many passages or copies there are, plays no part.
3. Candidates are confirmed by the longest common subsequence of terms, weighted by squared idf: a leak if it has SHARE of the
   passage's weight, or PARAPHRASE of it while the item's answer (its last sentence) is there too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.common import coded, mix64, rows_of, sliced, split_words, string_hash

SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
PASSAGE, WINDOW, STRIDE = 64, 64, 16
#: Passages that an executor holds at once; more are searched for in further passes.
PASSAGES = 20_000
SHARE, PARAPHRASE, ANSWER = 0.6, 0.4, 0.8
#: Share of a passage's weight, that of its lightest terms, which the first bound takes as found anywhere.
REST = 0.1
#: Chunks x passages that are summed, and pairs that are confirmed, at once.
CELLS, PAIRS = 1 << 18, 256


def terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the hash of each word's term, 0 for a word without letters and digits."""
    offsets, words = split_words(text)
    codes, distinct = coded(words)
    plain = pc.replace_substring_regex(pc.utf8_lower(distinct), r"[^\p{L}\p{N}]+", "")
    h = mix64(string_hash(plain)) | np.uint64(1)
    h[pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False).astype(bool)] = 0
    return offsets, h[codes] if len(codes) else np.empty(0, np.uint64)


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, the terms of each passage of at most PASSAGE words, half overlapping, and those of the item's last sentence."""
    for batch in batches:
        text = batch.column(1).fill_null("")
        sentences = [[s for s in re.split(r"[.!?]+", t) if re.search(r"\w", s)] for t in text.to_pylist()]
        tail = [s[-1] if len(s) > 1 else "" for s in sentences]
        offsets, h = terms(text)
        cut, answers = terms(pa.array(tail, pa.string()))
        ids, found, ends = [], [], []
        for i, item in enumerate(batch.column(0).to_pylist()):
            own = h[offsets[i] : offsets[i + 1]]
            own, answer = own[own > 0], answers[cut[i] : cut[i + 1]]
            for b in range(0, max(1, len(own) - PASSAGE // 2), PASSAGE // 2):
                if len(own):
                    ids.append(item)
                    found.append(own[b : b + PASSAGE].view(np.int64).tolist())
                    ends.append(answer[answer > 0].view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["item_id", "terms", "answer"])


def passages(benchmark: DataFrame) -> DataFrame:
    use = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return use.mapInArrow(_passages, "item_id long, terms array<long>, answer array<long>")


def document_frequencies(docs: DataFrame, known: np.ndarray) -> tuple[int, np.ndarray]:
    """Documents, and of these the ones that have each known slot."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, df, n = shared.value, np.zeros(SLOTS, np.int64), 0
        for batch in sliced(batches):
            offsets, h = terms(batch.column(0))
            s = slots(h)
            keep = (h > 0) & use[s]
            df += np.bincount(np.unique(rows_of(offsets)[keep] << SLOT_BITS | s[keep]) & (SLOTS - 1), minlength=SLOTS)
            n += batch.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["slot", "df"])

    found = docs.select("text").mapInArrow(count, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df")).toPandas()
    df, each = np.zeros(SLOTS), found["slot"] >= 0
    df[found["slot"][each].to_numpy(np.int64)] = found["df"][each]
    return int(found["df"][~each].sum()), df


def postings(lists: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each slot's postings begin; their passages and weights; the weight that each passage must have by them.

    A passage is listed under its heaviest slots, until the others have REST of its weight: a text with PARAPHRASE of
    the passage's weight has the rest of that by the listed ones.
    """
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    key, tf = np.unique(row << SLOT_BITS | slots(np.concatenate(lists)), return_counts=True)
    row, s = key >> SLOT_BITS, key & (SLOTS - 1)
    order = np.lexsort((-idf[s], row))
    row, s, w = row[order], s[order], (tf * idf[s])[order]
    mass = np.bincount(row, w, len(lists))
    total = np.cumsum(w) - w
    before = total - total[np.searchsorted(row, row)]
    listed = before < (1 - REST) * mass[row]
    need = PARAPHRASE * mass - (mass - np.bincount(row[listed], w[listed], len(lists)))
    row, s, w = row[listed], s[listed], w[listed]
    order = np.argsort(s, kind="stable")
    return np.searchsorted(s[order], np.arange(SLOTS + 1)), row[order], w[order], need


def common_weight(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the heaviest common subsequence of two sequences; ``weight`` is that of each element of ``a``."""
    best = np.zeros(len(b) + 1)
    for x, w in zip(a, weight, strict=True):
        best[1:] = np.maximum(best[1:], np.where(b == x, best[:-1] + w, 0))
        np.maximum.accumulate(best, out=best)
    return float(best[-1])


def common_shares(lists: list[np.ndarray], texts: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """Of each pair of a sequence and a text, the common_weight as a share of the sequence's weight."""
    n, m = max(map(len, lists)), max(map(len, texts))
    a, w, b = np.zeros((len(lists), n), np.uint64), np.zeros((len(lists), n)), np.zeros((len(lists), m), np.uint64)
    for i, (x, y, v) in enumerate(zip(lists, texts, weights, strict=True)):
        a[i, : len(x)], w[i, : len(x)], b[i, : len(y)] = x, v, y
    best = np.zeros((len(lists), m + 1))
    for k in range(n):
        best[:, 1:] = np.maximum(best[:, 1:], np.where(b == a[:, k, None], best[:, :-1] + w[:, k, None], 0))
        np.maximum.accumulate(best, axis=1, out=best)
    return best[:, -1] / w.sum(1)


def cosine(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """Cosine of the TF-IDF vectors of two sequences of terms."""
    (x, n), (y, m) = (np.unique(slots(v[v > 0]), return_counts=True) for v in (a, b))
    v, w = n * idf[x], m * idf[y]
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return float((v[i] * w[j]).sum() / max(np.sqrt((v * v).sum() * (w * w).sum()), 1e-12))


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, (first, passage, weight, need), items, lists, answers = shared.value
        weigh = lambda h: np.where(h > 0, idf[slots(h)], 0.0)
        masses, places = [weigh(x) for x in lists], [slots(x) for x in lists]
        there, count = np.zeros(SLOTS, bool), len(lists)

        def confirm(pairs: np.ndarray, found: dict, s: np.ndarray, h: np.ndarray, offsets: np.ndarray, doc: np.ndarray, k: np.ndarray) -> None:
            use = []
            for i, j in pairs.tolist():
                d = int(doc[i])
                begin = offsets[d] + STRIDE * k[i]
                b, e = max(offsets[d], begin - STRIDE), min(offsets[d + 1], begin + WINDOW + STRIDE)
                if found.get((d, items[j]), (0.0, 0.0))[1] >= 0.999:
                    continue
                there[s[b:e]] = True
                both = masses[j][there[places[j]]].sum()
                there[s[b:e]] = False
                if both >= PARAPHRASE * masses[j].sum() - 1e-9:
                    use.append((d, j, b, e))
            if not use:
                return
            shares = common_shares([lists[j] for _, j, _, _ in use], [h[b:e] for _, _, b, e in use], [masses[j] for _, j, _, _ in use])
            for (d, j, b, e), share in zip(use, shares.tolist(), strict=True):
                if share < PARAPHRASE or (share < SHARE and not len(answers[j])):
                    continue
                if share < SHARE:
                    wide = h[max(offsets[d], b - WINDOW) : min(offsets[d + 1], e + WINDOW)]
                    aw = weigh(answers[j])
                    if not common_weight(answers[j], wide, aw) >= ANSWER * aw.sum() > 0:
                        continue
                old = found.get((d, items[j]), (0.0, 0.0))
                found[d, items[j]] = max(old[0], cosine(h[b:e], lists[j], idf)), max(old[1], share)
        for batch in sliced(batches):
            offsets, h = terms(batch.column(1))
            s = slots(h)
            size = np.diff(offsets)
            # windows begin every STRIDE words and are searched with the STRIDE words on both sides: in whole chunks of STRIDE words
            per = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
            doc = np.repeat(np.arange(len(size)), per)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            chunks = -(-size // STRIDE)
            base = np.cumsum(chunks) - chunks
            lo, hi = base[doc] + np.maximum(k - 1, 0), base[doc] + np.minimum(k + WINDOW // STRIDE + 1, chunks[doc])
            at = np.flatnonzero((h > 0) & (first[s + 1] > first[s]))
            row = rows_of(offsets)[at]
            seen = np.unique((base[row] + (at - offsets[row]) // STRIDE) << SLOT_BITS | s[at])
            chunk, slot = seen >> SLOT_BITS, seen & (SLOTS - 1)
            found: dict[tuple[int, int], tuple[float, float]] = {}
            step = max(1, CELLS // count)
            for v in range(0, len(doc), step):
                low, high = lo[v : v + step], hi[v : v + step]
                c0, c1 = low[0], high[-1]
                mine = slice(*np.searchsorted(chunk, (c0, c1)))
                begin = first[slot[mine]]
                n = first[slot[mine] + 1] - begin
                pick = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cell = np.repeat(chunk[mine] - c0, n) * count + passage[pick]
                held = np.zeros((c1 - c0 + 1, count))
                np.cumsum(np.bincount(cell, weight[pick], (c1 - c0) * count).reshape(-1, count), axis=0, out=held[1:])
                # a slot in several chunks counts several times here, so this is never less than what the window has
                pairs = np.argwhere(held[high - c0] - held[low - c0] >= need * (1 - 1e-6) - 1e-9)
                for p in range(0, len(pairs), PAIRS):
                    confirm(pairs[p : p + PAIRS] + (v, 0), found, s, h, offsets, doc, k)
            keys = sorted(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in keys], pa.int64())), pa.array([x[1] for x in keys], pa.int64()), pa.array([found[x][0] for x in keys], pa.float64()), pa.array([found[x][1] for x in keys], pa.float64())], names=["doc_id", "item_id", "cosine", "share"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine and share for each document row and benchmark item that it leaks.

    Every window of every whole text is searched. NULL and empty texts leak nothing; benchmark rows without item_id or
    words are left out; a row without doc_id is reported with NULL; repeated rows are reported as often as they come.
    An empty benchmark leaks nowhere. Extra columns are ignored.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "doc_id long, item_id long, cosine double, share double")
    found = passages(benchmark)
    known = np.zeros(SLOTS, bool)
    # at most SLOTS rows, whatever the benchmark
    top = found.select(F.explode("terms").alias("t")).select(F.shiftrightunsigned("t", 64 - SLOT_BITS).cast("int").alias("s")).distinct().toPandas()
    known[top["s"].to_numpy(np.int64)] = True
    if not known.any():
        return empty
    n, df = document_frequencies(docs, known)
    # squared, so that words that most texts have weigh next to nothing in vectors, masses and subsequences alike
    idf = np.where(known, np.log((n + 1) / (df + 1)) ** 2 + 1e-3, 0.0)
    out = None
    for part in _blocks(found):
        lists = [np.array(r["terms"], np.int64).view(np.uint64) for r in part]
        answers = [np.array(r["answer"], np.int64).view(np.uint64) for r in part]
        shared = spark.sparkContext.broadcast((idf, postings(lists, idf), [r["item_id"] for r in part], lists, answers))
        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_search(shared), "doc_id long, item_id long, cosine double, share double")
        out = one if out is None else out.unionByName(one)
    return empty if out is None else out


def _blocks(found: DataFrame) -> Iterator[list]:
    """The passages, PASSAGES at a time."""
    part: list = []
    for r in found.toLocalIterator():
        part.append(r)
        if len(part) == PASSAGES:
            yield part
            part = []
    if part:
        yield part


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending) and share (the largest) of each doc_id of ``docs``; a NULL doc_id is one group."""
    found = leaks(docs, benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    joined = ids.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id"), "left")
    return joined.select("d.doc_id", F.col("f.item_ids").isNotNull().alias("contaminated"), F.coalesce("f.item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("f.share", F.lit(0.0)).alias("share"))
