"""The pipeline's rows against the stages' brute-force results, stage by stage."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from garimpo.llm import mixing, neardup, records, repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.collect())
    for _, f in corpus_pipeline.STAGES:
        rows = f(spark, docs, sf).collect()
        out.append(rows)
        docs = spark.createDataFrame(rows, docs.schema) if len(out) < 6 else docs
    return out


def test_run_gives_the_rows_of_the_stages(spark, sf, stages):
    """run(), with its tables written and read again between stages, on the whole table."""
    key = lambda r: (r.start, r.doc_id, r.n_tokens, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, stages[5]))


def test_rows_without_an_id_of_their_own(spark, sf):
    """Copies and leaks go where doc_ids are missing or repeated, too; nothing else does."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    text = lambda seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, 80))
    rows = [(None, text(1)), (None, text(1)), (None, text(2)), (4, text(3)), (4, text(3)), (4, text(4)), (None, f"{text(5)} {item} {text(6)}"), (5, text(7)), (6, text(7) + " tail")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, garimpo int")
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    assert kept.columns == docs.columns
    want = [(None, text(1)), (None, text(2)), (4, text(3)), (4, text(4)), rows[6], (5, text(7))]
    order = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=order) == sorted(want, key=order)
    clean = corpus_pipeline.decontamination(spark, kept, sf)
    assert {r.text for r in clean.collect()} == {t for _, t in want} - {rows[6][1]}
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), sf).count() == corpus_pipeline.decontamination(spark, docs.limit(0), sf).count() == 0


def test_stages_keep_the_columns(stages):
    for rows in stages[1:5]:
        assert rows and rows[0].__fields__ == stages[0][0].__fields__


def test_quality_and_near_duplicates(spark, stages):
    first = spark.createDataFrame(stages[0])
    kept = {r.doc_id for r in repetition.repetition(first).where("kept").collect()}
    assert {r.doc_id for r in stages[1]} == kept
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for r in stages[1] for w in [WORD.findall(r.text.lower())]}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in stages[2]} == {k for k in sets if root[k] == k}
    assert neardup.WIDTH == 5


def test_benchmark_passages_go(spark, sf, stages):
    items = [WORD.findall(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 12]) for w in items for i in range(len(w) - 11)}
    leaks = lambda t: any(tuple(w[i : i + 12]) in grams for w in [WORD.findall(t)] for i in range(len(w) - 11))
    before, after = {r.doc_id: r.text for r in stages[2]}, {r.doc_id for r in stages[3]}
    assert {k for k, t in before.items() if leaks(t)} == set(before) - after


def test_mix_and_records(spark, stages):
    copies = {r.doc_id: r.copies for r in mixing.copies(spark.createDataFrame(stages[3])).collect()}
    assert sorted(r.doc_id for r in stages[4]) == sorted(k for k, n in copies.items() for _ in range(n))
    enc, start = records.Encoder(records.vocabulary()), 0
    rows = sorted(stages[5], key=lambda r: r.start)
    for r, d in zip(rows, sorted(stages[4], key=lambda d: d.doc_id), strict=True):
        ids = [*enc.tok.encode(d.text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_columns_named_like_figures_keep_their_values(spark, sf):
    docs = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(60)), -1, False), (1, "short", -2, True)], "doc_id long, text string, n_words int, kept boolean")
    out = corpus_pipeline.quality_rules(spark, docs, sf)
    assert out.schema == docs.schema
    assert [(r.doc_id, r.n_words, r.kept) for r in out.collect()] == [(0, -1, False)]
