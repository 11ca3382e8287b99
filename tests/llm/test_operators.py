"""Each operator against a brute-force version on a small table with awkward rows."""

import hashlib
import json
import re
import struct
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from garimpo.llm import components, decontaminate, lines, mixing, neardup, ppm, quality, records, repetition, substring, toolcalls
from garimpo.llm.common import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


BASE = prose(1, 120)
TEXTS = {
    0: BASE, 1: BASE, 2: BASE.replace(BASE.split()[60], "changed"), 3: prose(2, 80), 4: None, 5: "", 6: " \t\n ", 7: "one", 8: "One", 9: "a b c",
    10: prose(3, 30) + " " + " ".join(BASE.split()[10:90]) + " " + prose(4, 30),
    11: "x y z\n" * 40, 12: "l1 a\nl2 b\nl3 c\nl4 d", 13: "zz\nl1 a\nl2 b\nl3 c\nq", 14: "it it it it it " * 30, 15: prose(5, 4000), 16: "é ñ " * 60, 17: prose(2, 80) + " tail",
}


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, 7) for k, t in TEXTS.items()] + [(None, BASE, None, None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_repetition(docs, empty):
    got = by_id(repetition.repetition(docs))
    for k, text in TEXTS.items():
        w = words(text)

        def covered(n, w=w):
            seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            return [j for j in range(len(w)) if any(0 <= i <= len(w) - n and seen[tuple(w[i : i + n])] > 1 for i in range(j - n + 1, j + 1))]

        assert got[k].n_words == len(w) and got[k].word_chars == sum(map(len, w))
        assert got[k].n_repeat_words == len(covered(3))
        assert got[k].dup_chars_5 == sum(len(w[j]) for j in covered(5))
        full = [x for x in (text or "").split("\n") if words(x)]
        assert got[k].n_dup_lines == len(full) - len(set(full))
    assert not got[11].kept and got[0].kept and got[5].base_failed and got[None].size == 7
    assert repetition.repetition(empty).count() == 0


def test_near_duplicates_brute_force(docs, empty):
    for width in (4, 5):
        sets = {}
        for k, text in TEXTS.items():
            w = words((text or "").lower())
            sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        root = {k: k for k in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
        got = by_id(neardup.near_duplicates(docs, width))
        assert {k: (got[k].n_shingles, got[k].component_id, got[k].kept) for k in sets} == {k: (len(sets[k]), root[k], root[k] == k) for k in sets}
        assert got[None].kept and got[None].component_id is None
    assert neardup.near_duplicates(empty).count() == 0


def test_dense_group_keeps_every_link(spark, monkeypatch):
    """Variants that are chained: most pairs are no links, and leaders alone don't settle it; dealt in several groups and blocks."""
    monkeypatch.setattr(neardup, "GROUP", 32)
    monkeypatch.setattr(neardup, "BLOCK", 40)
    rng = np.random.default_rng(0)
    base = prose(9, 60).split()
    rows = []
    for k in range(150):
        w = list(base)
        for i in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            w[i] = f"v{k}_{i}"
        rows.append((k, " ".join(w)))
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(57)} for k, t in rows}
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4))
    assert {k: got[k].component_id for k in sets} == {k: find(k) for k in sets}
    assert len({find(k) for k in sets}) > 1


def test_leader_with_two_texts(spark):
    """A doc_id on two rows: its near-copy is found, whichever of the two texts it is like."""
    ship(spark)
    rows = []
    for k in range(0, 20, 2):
        texts = [prose(200 + k, 120), prose(201 + k, 120)]
        rows += [(k, texts[0]), (k, texts[1]), (k + 1, texts[k // 2 % 2] + " tail")]
    got = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: (r.component_id, r.kept) for k, r in got.items()} == {k: (k - k % 2, k % 2 == 0) for k in range(20)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(50, 52), (52, 51), (7, 7), (60, 60), (50, 52)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 51: 50, 52: 50}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_substrings_brute_force(docs, empty):
    first = {}
    for k, text in TEXTS.items():
        w = words(text)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), k)
    got = by_id(substring.dedup_substrings(docs))
    for k, text in TEXTS.items():
        w = words(text)
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < k for j in range(i, i + 50)}
        assert (got[k].n_words, got[k].n_removed, got[k].kept_text) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    assert got[1].n_removed == 120 and got[10].n_removed == 80 and got[None].n_removed == 0
    assert substring.dedup_substrings(empty).count() == 0


def test_lines_brute_force(docs, empty):
    first = {}
    for k, text in TEXTS.items():
        ls = (text or "").split("\n")
        for i in range(len(ls) - 2):
            first.setdefault(tuple(ls[i : i + 3]), (k, i))
    got = by_id(lines.dedup_lines(docs))
    for k, text in TEXTS.items():
        ls = (text or "").split("\n")
        gone = {j for i in range(len(ls) - 2) if any(map(words, ls[i : i + 3])) and first[tuple(ls[i : i + 3])] != (k, i) for j in range(i, i + 3)}
        assert (got[k].n_lines, got[k].n_removed, got[k].kept_text) == (len(ls), len(gone), "\n".join(x for j, x in enumerate(ls) if j not in gone))
    assert got[13].n_removed == 3
    assert lines.dedup_lines(empty).count() == 0


def test_mixing(spark, docs, empty):
    got = by_id(mixing.copies(docs.drop("size")))
    total = sum(len(words(r.text)) for r in docs.collect())
    aims = {r.source: (r.target, r.source_size) for r in got.values()}
    assert sum(a for a, _ in aims.values()) == pytest.approx(1.5 * total)
    assert all(a <= 2 * s + 1e-6 for a, s in aims.values())
    for source, (aim, _) in aims.items():
        rows = [r for r in got.values() if r.source == source]
        assert all(0 <= r.taken <= 2 * r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - aim) <= max(r.size for r in rows)
    assert mixing.mix(docs).count() == sum(r.copies for r in got.values())
    assert mixing.copies(empty).count() == 0
    sizes = spark.createDataFrame([("a", 100), ("b", 10), (None, 0), ("c", 1000)], "source string, source_size long")
    level = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert level["b"] == 20 and level[None] == 0 and level["a"] == 200 and level["c"] == pytest.approx(1.5 * 1110 - 220)


def test_records_round_trip(docs, empty):
    got = records.token_output(docs).collect()
    enc = records.Encoder(records.vocabulary())
    start = 0
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)):
        text = BASE if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = [*enc.tok.encode(text, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert len(got) == len(TEXTS) + 1
    assert records.token_output(empty).count() == 0


def test_frames_notice_damage():
    data = records.frame(records.pack(5, np.array([1, 70000], np.uint32))) + records.frame(b"")
    found = [p for _, p in records.frames(data)]
    assert records.unpack(found[0])[0] == 5 and records.unpack(found[0])[1].tolist() == [1, 70000] and found[1] == b""
    for at in (0, 9, 14, len(data) - 3):
        with pytest.raises(ValueError):
            list(records.frames(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))


def test_encoder_is_exact():
    rng = np.random.default_rng(3)
    parts = [" ", "  ", "\n", "\n\n", "\t", " \n", "\n ", "a", "The", "don't", "'s", ",", "...", "!!", "12", "é", "ção", "日本", "\u00a0", "\u2003", "\x1c", "\x85", "²", "_", "<|endoftext|>", "😀", "e\u0301", "\r\n"]
    texts = ["", " ", "\n"] + ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 12))) for _ in range(3000)]
    enc = records.Encoder(records.vocabulary())
    for i in range(0, len(texts), 500):
        assert [x.tolist() for x in enc.encode(pa.array(texts[i : i + 500]))] == enc._whole(texts[i : i + 500])


def test_added_tokens_keep_their_ids(spark):
    """As a fresh tokenizer gives them, in the encoder and in the records."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(records.vocabulary())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\nz", "<|endoftext", "a b", "", "a <|endoftext|><|endoftext|>\n\nb"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    enc = records.Encoder(records.vocabulary())
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(pa.array(texts))] == want
    got = by_id(records.token_output(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[k].n_tokens for k in range(len(texts))] == [len(x) + 1 for x in want]
    assert [got[k].ids_crc32 for k in range(len(texts))] == [zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for x in want]


def test_encoder_takes_words_together():
    """Neither words that are new to it nor those it knows cost calls of their own."""
    rng = np.random.default_rng(17)
    new = ["".join(x) for x in rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), (20_000, 9))]
    texts = [" ".join(new[i : i + 500]) for i in range(0, len(new), 500)]
    enc, calls = records.Encoder(records.vocabulary()), [0]
    want = enc._whole(texts)

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    for _ in range(2):
        calls[0] = 0
        sys.setprofile(count)
        try:
            got = enc.encode(pa.array(texts))
        finally:
            sys.setprofile(None)
        assert [x.tolist() for x in got] == want
        assert calls[0] < len(new) // 4


@pytest.mark.parametrize("clash", [False, True])
def test_encoder_tells_its_words_apart(monkeypatch, clash):
    """Words over the length that is kept, zeros at a word's end, words that share a hash, and a store that is often thinned."""
    if clash:
        monkeypatch.setattr(records, "hashed", lambda keys: np.zeros(len(keys), np.uint64), raising=False)
    monkeypatch.setattr(records, "CACHE", 60)
    rng = np.random.default_rng(19)
    pool = ["a", "a\0", "\0", "x" * 31, "x" * 32, "x" * 33, "x" * 32 + "y", "é" * 16, "é" * 17, "日本" * 9, "no", "No", "no.", "no..", "no1", "don't"]
    pool += ["".join(x) for x in rng.choice(list("abcé"), (60, 5))]
    enc = records.Encoder(records.vocabulary())
    for k in range(40):
        texts = [" ".join(pool[i] for i in rng.integers(0, len(pool), 12)) for _ in range(5)]
        assert [x.tolist() for x in enc.encode(pa.array(texts, pa.large_string() if k % 2 else pa.string()))] == enc._whole(texts)


def code_length(counts, text):
    """Prediction by partial matching, byte by byte."""
    data = b"\n" * ppm.ORDER + text.lower().encode()
    bits = 0.0
    for i in range(ppm.ORDER, len(data)):
        for order in range(ppm.ORDER, -2, -1):
            if order < 0:
                bits += 8
                break
            seen = counts.get(data[i - order : i], {})
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits += np.log2(total / seen[data[i]])
                break
            bits += np.log2(total / len(seen))
    return bits


def test_language_id(spark):
    ship(spark)
    train = [(0, "the cat and the dog", "en"), (1, "der hund und die katze", "de"), (2, "the end", "en"), (3, None, "en"), (4, "x", None)]
    probe = spark.createDataFrame([(9, "the dog and a cat, né"), (10, "die katze"), (11, ""), (12, None), (13, "123 !"), (14, "ÉÇ 日本")], "doc_id long, text string")
    trees = ppm.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    got = by_id(ppm.identify(probe, trees))
    for lang in ("en", "de"):
        counts = {}
        for _, text, label in train:
            if label == lang and text:
                data = b"\n" * ppm.ORDER + text.encode()
                for i in range(ppm.ORDER, len(data)):
                    for order in range(ppm.ORDER + 1):
                        counts.setdefault(data[i - order : i], Counter())[data[i]] += 1
        for k, text in ((9, "the dog and a cat, né"), (10, "die katze"), (14, "ÉÇ 日本")):
            want = code_length(counts, text)
            assert ppm.code_lengths(trees, pa.array([text]))[0][trees.langs.index(lang)] == pytest.approx(want, rel=1e-5)
    assert (got[9].lang_pred, got[10].lang_pred) == ("en", "de")
    assert {got[k].lang_pred for k in (11, 12, 13)} == {"und"} and all(0 <= r.score <= 1 for r in got.values())
    none = ppm.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert by_id(ppm.identify(probe, none))[9].lang_pred == "und"


def test_held_out_accuracy(spark, sf):
    ship(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = ppm.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95
    scored = quality.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert quality.auc(scored) > 0.8


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (11, 0), (14, 0), (3, 1), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    got = by_id(quality.quality_scores(docs, labels))
    assert len(got) == len(TEXTS) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert got[4].score == got[5].score == got[6].score
    assert quality.quality_scores(empty, labels).count() == 0
    assert by_id(quality.quality_scores(docs, labels.limit(0)))[0].score == 0.5


def test_decontamination(spark, docs, empty):
    items = [(1, prose(70, 30) + ". The answer is " + prose(71, 6)), (2, prose(72, 150)), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    a, b = items[0][1].split(), items[1][1].split()
    changed = [("other" if i % 6 == 5 else w) for i, w in enumerate(a)]
    made = [(100, prose(80, 90) + " " + " ".join(a) + " " + prose(81, 70)), (101, " ".join(changed).upper()), (102, prose(82, 300)), (103, " ".join(b[20:110])), (104, None)]
    extra = spark.createDataFrame(made, "doc_id long, text string")
    got = by_id(decontaminate.decontaminate(docs.select("doc_id", "text").union(extra), bench))
    assert got[100].item_ids == [1] and got[101].item_ids == [1] and got[103].item_ids == [2]
    assert not any(got[k].contaminated for k in [*TEXTS, None, 102, 104])
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not by_id(decontaminate.decontaminate(extra, bench.limit(0)))[100].contaminated


def plain_leaks(texts, items):
    """Documents and items by the rule, over every place: {(doc, item)} for all windows of WINDOW words, and for those
    that the operator searches, with STRIDE words more on both sides."""
    D = decontaminate
    split = lambda t: [w for w in (re.sub(r"[\W_]+", "", w.lower()) for w in words(t))]
    docs = {k: split(t) for k, t in texts.items()}
    passages = []
    for i, t in items:
        own, ends = [w for w in split(t) if w], [x for x in re.split(r"[.!?]+", t) if re.search(r"\w", x)]
        answer = [w for w in split(ends[-1]) if w] if len(ends) > 1 else []
        passages += [(i, own[b : b + D.PASSAGE], answer) for b in range(0, max(1, len(own) - D.PASSAGE // 2), D.PASSAGE // 2)]
    df = Counter(w for d in docs.values() for w in set(d))
    weigh = lambda ws: np.array([np.log((len(docs) + 1) / (df[w] + 1)) ** 2 + 1e-3 if w else 0.0 for w in ws])
    names = {w: k + 1 for k, w in enumerate(sorted({w for d in docs.values() for w in d if w} | {w for _, p, a in passages for w in p + a}))}
    code = lambda ws: np.array([names.get(w, 0) for w in ws], np.uint64)

    def leak(d, b, e, p, answer):
        share = D.common_weight(code(p), code(d[b:e]), weigh(p)) / weigh(p).sum()
        wide, aw = d[max(0, b - D.WINDOW) : e + D.WINDOW], weigh(answer)
        return share >= D.SHARE or (share >= D.PARAPHRASE and len(answer) > 0 and D.common_weight(code(answer), code(wide), aw) >= D.ANSWER * aw.sum())

    def found(ranges):
        return {(k, i) for k, d in docs.items() for i, p, answer in passages if any(set(p) & set(d[b:e]) and leak(d, b, e, p, answer) for b, e in ranges(len(d)))}

    searched = lambda n: [(max(0, b - D.STRIDE), min(n, b + D.WINDOW + D.STRIDE)) for b in range(0, max(1, n - D.WINDOW + D.STRIDE), D.STRIDE)] if n else []
    return found(lambda n: [(b, min(n, b + D.WINDOW)) for b in range(max(1, n - D.WINDOW + 1))] if n else []), found(searched)


def test_leaks_brute_force(spark):
    """Paraphrases from slight to heavy, with and without the answer: the operator finds what a search of all places finds."""
    rng = np.random.default_rng(23)
    text = lambda n: " ".join(f"w{int(x)}" for x in 900 * rng.random(n) ** 2)
    items = [(k, f"{text(int(rng.integers(12, 40)))}. {text(5)}.") for k in range(6)] + [(6, text(100))]
    texts = {}
    for k in range(40):
        own = items[k % 7][1].split()
        keep = [w if rng.random() > k / 60 else f"x{int(rng.integers(500))}" for w in own]
        keep[-5:] = own[-5:] if k % 2 else keep[-5:]
        texts[k] = f"{text(int(rng.integers(0, 60)))} {' '.join(keep)} - {text(int(rng.integers(0, 60)))}"
    texts |= {100: "", 101: None, 102: text(150), 103: items[0][1].upper()}
    every, searched = plain_leaks(texts, items)
    ship(spark)
    found = decontaminate.leaks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == searched and every <= got
    assert 10 < len(got) < 40


def test_copies_of_many_passages_are_found(spark):
    """Whole items in other texts of the same words: every one is found, and no text without an item is."""
    rng = np.random.default_rng(21)
    text = lambda n: " ".join(f"w{int(x)}" for x in 3000 * rng.random(n) ** 2)
    items = [(k, text(int(rng.integers(15, 60)))) for k in range(1500)]
    made = [(k, " ".join(text(90) + " " + t for _, t in items[5 * k : 5 * k + 5]) + " " + text(90)) for k in range(300)]
    clean = [(1000 + k, text(500)) for k in range(200)]
    ship(spark)
    got = by_id(decontaminate.decontaminate(spark.createDataFrame(made + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    found = {(k, i) for k, r in got.items() for i in r.item_ids}
    assert found == {(k // 5, k) for k in range(1500)}


def test_item_in_a_third_of_the_documents(spark):
    """Its words weigh little then, and much less than the words around them."""
    rng = np.random.default_rng(22)
    text = lambda n: " ".join(f"w{int(x)}" for x in 3000 * rng.random(n) ** 2)
    items = [(k, text(int(rng.integers(15, 60)))) for k in range(40)]
    made = [(k, f"{text(120)} {items[0][1]} {text(120)}" if k % 3 == 0 else text(250)) for k in range(600)]
    ship(spark)
    got = by_id(decontaminate.decontaminate(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert {k: r.item_ids for k, r in got.items()} == {k: [0] if k % 3 == 0 else [] for k in range(600)}


def test_common_shares():
    rng = np.random.default_rng(7)
    lists, texts = ([rng.integers(1, 6, int(n)).astype(np.uint64) for n in rng.integers(1, 12, 40)] for _ in range(2))
    weights = [rng.random(len(x)) for x in lists]
    assert decontaminate.common_shares(lists, texts, weights) == pytest.approx([decontaminate.common_weight(a, b, w) / w.sum() for a, b, w in zip(lists, texts, weights, strict=True)])


def test_heaviest_common_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = rng.integers(0, 5, 9), rng.integers(0, 5, 11)
        w = rng.random(9)
        best = np.zeros((10, 12))
        for i in range(9):
            for j in range(11):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + w[i] if a[i] == b[j] else 0)
        assert decontaminate.common_weight(a, b, w) == pytest.approx(best[-1, -1])


def test_tool_calls(spark):
    ship(spark)
    schema = toolcalls.canonical({"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "s": {"enum": ["a", "b"]}}, "required": ["n"], "additionalProperties": False})
    calls = [(1, 3, "c", "t", '{"n": 2, "s": "b"}', ["a", "b"]), (1, 1, "a", "t", '{"n": 1}', None), (1, 2, "b", "t", '{"s":"z","q":1}', ["a", "lost", None]), (1, 4, "x", "t", "{bad", ["y"]), (1, 5, "y", "no", '{"n":1}', ["x"]), (2, 1, "a", "t", None, []), (2, 2, None, "t", '{"n":1}', []), (1, 1, "a", "t", '{"n": 1}', None)]
    results = [(1, "a", "ok"), (1, "c", None), (1, "z", "late"), (1, "a", "again")]
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, arguments string, needs array<string>"), spark.createDataFrame(results, "conv_id long, call_id string, content string"), spark.createDataFrame([("t", schema)], "tool string, schema string")).collect()}
    assert {k: (r.level, r.place, r.status, r.valid) for k, r in got.items()} == {
        (1, "a"): (0, 1, "linked", True), (1, "b"): (1, 2, "unanswered", False), (1, "c"): (2, 3, "linked", True), (1, "x"): (None, 4, "unanswered", False), (1, "y"): (None, 5, "unanswered", False),
        (1, "z"): (None, 6, "orphan", None), (2, "a"): (0, 1, "unanswered", False), (2, None): (None, 2, "unidentified", True),
    }
    assert got[1, "a"].json == '{"arguments":{"n":1},"id":"a","name":"t","result":"again"}'
    assert got[1, "b"].error == "$.n: missing; $.q: not allowed; $.s: not in enum"


def test_null_turns_have_their_rows(spark):
    """A user's turn without number is a call without call_id, an assistant's a result without a call; each has a row."""
    ship(spark)
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, None, "user", "lost"), (1, None, "assistant", "astray"), (1, None, "assistant", "astray"), (1, None, "assistant", None), (2, None, "assistant", "alone")]
    rows = toolcalls.link(*toolcalls.from_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    got = Counter((r.conv_id, r.call_id, r.level, r.status, r.valid, json.loads(r.json)["result"]) for r in rows)
    assert got == {
        (1, "0", 0, "linked", True, "yes"): 1, (1, None, None, "unidentified", False, None): 1, (1, None, None, "orphan", None, "astray"): 2,
        (1, None, None, "orphan", None, None): 1, (2, None, None, "orphan", None, "alone"): 1,
    }
    assert sorted(r.place for r in rows if r.conv_id == 1) == [1, 2, 3, 4, 5]


def test_digests(docs):
    got = by_id(substring.dedup_substrings(docs).withColumn("d", F.sha2("kept_text", 256)))
    assert got[5].d == hashlib.sha256(b"").hexdigest()


def brute_features(text):
    """Counts of the classifier's features by their own keys, without hashing into slots."""
    w = words(text)
    shape = lambda x: re.sub(r"A+", "A", re.sub(r"a+", "a", re.sub(r"0+", "0", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isnumeric() else c for c in x))))
    lower, shapes = [x.lower() for x in w], [shape(x) for x in w]
    out = Counter(("w", x) for x in lower) + Counter(("s", x) for x in shapes)
    for kind, xs in (("w", lower), ("s", shapes)):
        out += Counter((kind, a, b) for a, b in zip(xs, xs[1:]))
    return out + Counter(("=", a == b, b == c, a == c) for a, b, c in zip(w, w[1:], w[2:]))


def test_features_brute_force():
    texts = [BASE, "One two one TWO 3 33 3x\nÉcole école!", "", None, "a a a b", "x"]
    row, slot, value = quality.features(pa.array(texts))
    for k, text in enumerate(texts):
        want = brute_features(text)
        got = value[row == k]
        assert len(set(slot[row == k].tolist())) == len(got)
        norm = sum(want.values()) ** 0.5
        assert sorted(np.round(got, 9).tolist()) == sorted(round(n**0.5 / norm, 9) for n in want.values())
    again = quality.features(pa.array([texts[1]]))
    assert np.array_equal(again[1], slot[row == 1]) and np.array_equal(again[2], value[row == 1])


def test_follow_brute_force():
    rng = np.random.default_rng(11)
    examples = [(rng.choice(40, 6, replace=False), rng.random(6), int(rng.integers(0, 2))) for _ in range(60)]
    z, n = Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)
    for _ in range(quality.EPOCHS):
        for slot, value, label in examples:
            pairs = [*zip(slot.tolist(), value.tolist()), ("bias", 1.0)]
            ws = {i: weight(i) for i, _ in pairs}
            g = 1 / (1 + np.exp(-sum(ws[i] * v for i, v in pairs))) - label
            for i, v in pairs:
                z[i] += g * v - ((n[i] + (g * v) ** 2) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * ws[i]
                n[i] += (g * v) ** 2
    w, bias = quality.follow(examples)
    assert bias == pytest.approx(weight("bias")) and [w[i] for i in range(40)] == pytest.approx([weight(i) for i in range(40)], rel=1e-5)


def test_lists_give_the_lengths_of_the_table(monkeypatch):
    rng = np.random.default_rng(12)
    text = ["".join(rng.choice(list("abcdeé \n"), 400)) for _ in range(6)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y", "x", "y", "z", "z"]), pa.array(text)], names=["lang", "text"])
    found = pa.concat_batches(list(ppm.count_grams(iter([batch])))).to_pandas().groupby(["lang", "gram"], as_index=False)["n"].sum()
    trees = lambda: ppm.Trees(["x", "y", "z"], found["lang"].map({"x": 0, "y": 1, "z": 2}).to_numpy(), found["gram"].to_numpy(), found["n"].to_numpy())
    probe = pa.array([*text, "", "zzz", "a" * 3000, "日本 abc"])
    want = ppm.code_lengths(trees(), probe)
    monkeypatch.setattr(ppm, "MAX_CELLS", 10)
    assert trees().table() is None
    assert ppm.code_lengths(trees(), probe) == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_language_id_holds_little_beside_its_table():
    """Neither making the table nor scoring a long text takes memory by the number of languages."""
    rng = np.random.default_rng(20)
    pool = list("abcdefghijklmnopqrstuvwxyzé .,")
    text = ["".join(rng.choice(pool, 600)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"l{k:02}" for k in range(40)]), pa.array(text)], names=["lang", "text"])
    found = pa.concat_batches(list(ppm.count_grams(iter([batch])))).to_pandas()
    trees = ppm.Trees(sorted(found["lang"].unique()), found["lang"].str[1:].astype(int).to_numpy(), found["gram"].to_numpy(), found["n"].to_numpy())
    long = pa.array(["".join(rng.choice(pool, ppm.BLOCK))])
    tracemalloc.start()
    try:
        size = sum(x.nbytes for x in trees.table()[:3])
        assert size > 50e6 and tracemalloc.get_traced_memory()[1] < 2 * size
        assert ppm.code_lengths(trees, pa.array([text[7]])).argmin() == 7
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        assert ppm.code_lengths(trees, long).shape == (1, 40)
        assert tracemalloc.get_traced_memory()[1] - before < 64 * ppm.BLOCK
    finally:
        tracemalloc.stop()
        ppm._TABLES.clear()


def test_sample_is_whole_up_to_its_bound(spark):
    """All documents of a language are learned from while there are no more than the bound, and one row of a repeated doc_id."""
    ship(spark)
    rows = [(k % 90, "ab" if k < 90 else "ba", "en") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert ppm.learn(docs, 90).n.sum() == 90 * 2
    assert ppm.learn(docs, 50).n.sum() == 50 * 2


def test_records_of_repeated_ids(spark):
    ship(spark)
    rows = [(k % 3 if k % 4 else None, f"text {k} " * (k % 5)) for k in range(60)] + [(1, None), (1, None)]
    got = sorted(records.token_output(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.start)
    enc = records.Encoder(records.vocabulary())
    crc = lambda t: zlib.crc32(np.array([*enc.tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((d, crc(t)) for d, t in rows)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is None, d))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]


def test_very_long_texts(spark):
    """A text over what a worker handles at once, beside short ones, in every operator on documents."""
    ship(spark)
    long = " ".join(f"w{x}" for x in np.random.default_rng(13).integers(0, 10**6, 700_000))
    assert len(long) > 4 << 20
    rows = [(0, BASE, "en", "a"), (1, long, "en", "b"), (2, long + " " + BASE, "en", "b"), (3, BASE, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {k: r.n_words for k, r in by_id(repetition.repetition(docs).drop("text")).items()} == {0: 120, 1: 700_000, 2: 700_120, 3: 120}
    assert {k: r.component_id for k, r in by_id(neardup.near_duplicates(docs)).items()} == {0: 0, 1: 1, 2: 1, 3: 0}
    assert {k: r.n_removed for k, r in by_id(substring.dedup_substrings(docs).drop("kept_text")).items()} == {0: 0, 1: 0, 2: 700_120, 3: 120}
    assert {k: r.n_removed for k, r in by_id(lines.dedup_lines(docs).drop("kept_text")).items()} == {0: 0, 1: 0, 2: 0, 3: 0}
    assert set(by_id(ppm.language_id(docs))) == {0, 1, 2, 3}
    assert set(by_id(quality.quality_scores(docs, spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int")))) == {0, 1, 2, 3}
    bench = spark.createDataFrame([(7, " ".join(BASE.split()[:60]))], "item_id long, text string")
    assert {k: r.item_ids for k, r in by_id(decontaminate.decontaminate(docs, bench)).items()} == {0: [7], 1: [], 2: [7], 3: [7]}
    got = by_id(records.token_output(docs))
    assert got[1].start == got[0].n_tokens and got[2].n_tokens > got[1].n_tokens > 700_000


def test_two_rows_of_one_id(spark):
    """They aren't compared with each other, and all others are compared with both."""
    ship(spark)
    other = prose(40, 90)
    docs = spark.createDataFrame([(1, BASE), (1, other), (1, BASE), (2, BASE), (3, other), (0, "a\nb\nc\nd"), (5, "a\nb\nc\nd"), (5, "x\ny\nz")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.dedup_substrings(docs).collect())
    assert got == {(1, 120, 0): 2, (1, 90, 0): 1, (2, 120, 120): 1, (3, 90, 90): 1, (0, 4, 0): 1, (5, 4, 0): 1, (5, 3, 0): 1}
    assert Counter((r.doc_id, r.n_removed) for r in lines.dedup_lines(docs).collect()) == {(1, 0): 3, (2, 0): 1, (3, 0): 1, (0, 0): 1, (5, 4): 1, (5, 0): 1}
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 1), (0, 0), (5, 0), (5, 5)}
    assert Counter(r.doc_id for r in repetition.repetition(docs).collect()) == {1: 3, 2: 1, 3: 1, 0: 1, 5: 2}


def test_columns_with_the_figures_names(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * (k % 7), "ab"[k % 2], -k, "t", k, 1.5, "n") for k in range(40)], "doc_id long, text string, source string, size int, target string, mix_0 int, nth double, source_size string")
    got = mixing.mix(docs)
    assert got.columns == docs.columns and {(r.size, r.target, r.mix_0, r.nth, r.source_size) for r in got.collect()} <= {(-k, "t", k, 1.5, "n") for k in range(40)}
    plain = by_id(mixing.copies(docs.select("doc_id", "text", "source")))
    assert {r.doc_id: (r.size, r.target, r.taken) for r in mixing.copies(docs).collect()} == {k: (r.size, r.target, r.taken) for k, r in plain.items()}
    assert Counter(r.doc_id for r in got.collect()) == +Counter({k: r.copies for k, r in plain.items()})


def test_awkward_arguments_and_schemas(spark):
    """Nothing that a call or a tool holds ends the job."""
    ship(spark)
    texts = ['{"n":1e999}', "[" * 100_000, '{"n":"\\ud800"}', '{"n":1.0}', '{"n":true}', "NaN", "", '{"n":1}']
    schemas = {"int": '{"properties":{"n":{"type":"integer"}}}', "dec": '{"properties":{"n":{"type":"decimal"}}}', "bad": "{", "odd": '{"required":3}', "list": "[]"}
    calls = [(1, k, f"{tool}{k}", tool, t, None, "extra") for tool in schemas for k, t in enumerate(texts)]
    frame = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, arguments string, needs array<string>, status string")
    tools = spark.createDataFrame(list(schemas.items()), "tool string, schema string")
    none = spark.createDataFrame([], "conv_id long, call_id string, content string")
    got = {r.call_id: r for r in toolcalls.link(frame, none, tools).collect()}
    assert [got[f"int{k}"].error for k in range(8)] == ["arguments have a number out of range", "arguments are nested too deep", "$.n: not integer", None, "$.n: not integer", "arguments aren't JSON", "arguments aren't JSON", None]
    assert {got[f"{s}7"].error for s in ("dec", "bad", "odd", "list")} == {"the tool's schema can't be applied"}
    assert json.loads(got["int2"].json)["arguments"] == {"n": "\ud800"} and json.loads(got["int0"].json)["arguments"] is None
    assert toolcalls.link(frame.limit(0), none, tools).count() == 0
    one = toolcalls.link(frame.limit(0), spark.createDataFrame([(None, "x", "y")], none.schema), tools.limit(0)).collect()
    assert [(r.status, r.valid) for r in one] == [("orphan", None)]


def test_levels_in_one_task_and_in_rounds(spark):
    rng = np.random.default_rng(14)
    edges = {(str(c), f"{c}-{int(a)}", f"{c}-{int(b)}") for c in range(6) for a, b in rng.integers(0, 12, (14, 2)) if c % 2 or a > b}
    frame = spark.createDataFrame(sorted(edges), "conv string, id string, needs string")
    want = toolcalls.order([e[1:] for e in edges])
    for most in (0, 8, 1000):
        assert {r.id: r.level for r in toolcalls.levels(frame, most).collect()} == want
    for ident, level in want.items():
        needs = [n for _, i, n in edges if i == ident]
        assert level == (1 + max(want[n] for n in needs) if needs else 0)


def test_the_smallest_call_is_a_call(spark):
    ship(spark)
    calls = [(1, 2, "a", "t", '{"x":1}', None), (1, 1, "a", "u", '{"x":2}', None)]
    got = toolcalls.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, arguments string, needs array<string>"), spark.createDataFrame([], "conv_id long, call_id string, content string"), spark.createDataFrame([], "tool string, schema string")).collect()
    assert [r.json for r in got] == ['{"arguments":{"x":2},"id":"a","name":"u","result":null}']
