"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: for every context of up to ORDER bytes the counts of the bytes that
followed it. A byte costs -log2 of its probability in the longest context that has seen it, plus the escapes on the
way down (escape method C: distinct followers / (count + distinct followers)); below order 0 all 256 bytes are alike.
The statistics are frozen while a text is scored, so its code length is a plain sum and can be read from a table, or
from sorted lists where the table would be too large.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo.llm.common import crc_mod, sliced

ORDER = 3
#: The trees are learned from this many documents of each language at most, those whose id has the smallest hash; they
#: are chosen among as many of each of SALTS classes of hashes.
DOCS_PER_LANG, SALTS = 448, 64
#: Contexts x symbols x languages in a table of costs. Larger statistics are kept as sorted lists, which take longer to
#: search and give the same code lengths.
MAX_CELLS = 32 << 20
#: Positions that are scored at once.
BLOCK = 1 << 20
_PAD = b"\n" * ORDER


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts, each behind ORDER line ends, and where each text begins in them."""
    text = pc.binary_join_element_wise(pa.scalar(_PAD.decode(), text.type), pc.utf8_lower(text.fill_null("")), pa.scalar("", text.type))
    size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    at = text.offset
    first = np.frombuffer(text.buffers()[1], np.int32 if text.type == pa.string() else np.int64)[at]
    return np.frombuffer(text.buffers()[2], np.uint8)[first : first + begin[-1]], begin


def _grams(data: np.ndarray) -> np.ndarray:
    """At each position from ORDER on, the byte with the ORDER bytes before it as one number, the oldest byte highest."""
    n = len(data) - ORDER
    out = np.zeros(max(n, 0), np.uint32)
    for j in range(ORDER + 1):
        out = (out << np.uint32(8)) | data[j : n + j]
    return out


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        langs = batch.column(batch.schema.get_field_index("lang"))
        for lang in langs.unique().to_pylist():
            text = batch.column(batch.schema.get_field_index("text")).filter(pc.equal(langs, lang))
            data, begin = _bytes(text)
            inside = np.ones(len(data), bool)
            for j in range(ORDER):
                inside[begin[:-1] + j] = False
            grams, n = np.unique(_grams(data)[inside[ORDER:]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


class Trees:
    """The frozen statistics: every language's counts of byte, context pairs. The table of costs is made where it is used."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.key, self.langs = uuid.uuid4().hex, langs
        self.lang, self.gram, self.n = lang.astype(np.int16), gram.astype(np.uint32), n.astype(np.int64)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int] | None:
        """Symbol of each byte; row of each context; a row of costs for each language, by row * symbols + symbol; symbols.

        Symbol 0 stands for all bytes that no language has seen: they cost alike and no context has them. None if the
        table would have more than MAX_CELLS cells. Besides the table only one language's shorter contexts are held.
        """
        seen = np.unique(np.concatenate([self.gram & np.uint32(255), np.frombuffer(_PAD[:1], np.uint8).astype(np.uint32)]))
        a, count = len(seen) + 1, len(self.langs)
        contexts = sum(len(np.unique(self.gram >> np.uint32(8) & np.uint32((1 << 8 * k) - 1))) for k in range(ORDER + 1))
        if max((contexts + 1) * a * count, a**ORDER) > MAX_CELLS:
            return None
        symbol = np.zeros(256, np.int32)
        symbol[seen] = np.arange(1, len(seen) + 1)
        parts = [symbol[(self.gram >> np.uint32(8 * j)) & np.uint32(255)] for j in range(ORDER, -1, -1)]  # oldest first
        index = np.zeros(1, np.int32)  # row of each context of the order before, by its number
        rows, orders = 1, []  # of each order: its first row, the row of each gram's context, that of each context's suffix
        for order in range(ORDER + 1):
            ctx = np.zeros(len(self.gram), np.int64)
            for p in parts[ORDER - order : ORDER]:
                ctx = ctx * a + p
            known, row = np.unique(ctx, return_inverse=True)
            orders.append((rows, row, index[known % a ** max(order - 1, 0)] if order else np.zeros(len(known), np.int32)))
            # contexts that no language has seen have the row of their longest seen suffix
            index = np.tile(index, a) if order else index
            index[known] = rows + np.arange(len(known))
            rows += len(known)
        cost = np.empty((count, rows, a), np.float32)
        for k in range(count):
            mine = self.lang == k
            last, n = parts[ORDER][mine], self.n[mine]
            exact = np.empty((orders[-1][0], a))  # costs by context of the orders before the last
            exact[0] = np.log2(256.0)
            for start, row, suffix in orders:
                pairs, back = np.unique(row[mine] * a + last, return_inverse=True)
                freq, context = np.bincount(back, n, len(pairs)), pairs // a
                kinds = np.bincount(context, minlength=len(suffix))
                whole = np.bincount(context, freq, len(suffix)) + kinds
                escape = np.log2(whole / np.maximum(kinds, 1), out=np.zeros(len(suffix)), where=kinds > 0)
                to = (cost[k] if start == len(exact) else exact)[start : start + len(suffix)]
                for lo in range(0, len(suffix), max(1, BLOCK // a)):
                    some = slice(lo, lo + max(1, BLOCK // a))
                    to[some] = exact[suffix[some]] + escape[some, None]
                to[context, pairs % a] = np.log2(whole[context] / freq)
            cost[k, : len(exact)] = exact
        return symbol, index, cost.reshape(count, -1), a

    def lists(self, lang: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each order, from the longest: seen context-byte pairs with their costs, and seen contexts with their escapes', ascending."""
        mine = self.lang == lang
        out = []
        for order in range(ORDER, -1, -1):
            pairs, back = np.unique(self.gram[mine] & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            freq = np.bincount(back, self.n[mine], len(pairs))
            contexts, back = np.unique(pairs >> np.uint32(8), return_inverse=True)
            kinds = np.bincount(back, minlength=len(contexts))
            whole = np.bincount(back, freq, len(contexts)) + kinds
            out.append((pairs, np.log2(whole[back] / freq), contexts, np.log2(whole / kinds)))
        return out


def listed_costs(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], grams: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each gram."""

    def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        there = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
        return there, np.where(there, values[at], 0.0) if len(keys) else np.zeros(len(wanted))

    out, left = np.zeros(len(grams)), np.arange(len(grams))
    for order, (pairs, cost, contexts, escape) in zip(range(ORDER, -1, -1), lists, strict=True):
        g = grams[left] & np.uint32((1 << 8 * (order + 1)) - 1)
        seen, bits = find(pairs, cost, g)
        out[left] += bits
        left, g = left[~seen], g[~seen]
        out[left] += find(contexts, escape, g >> np.uint32(8))[1]
    out[left] += 8
    return out


_TABLES: dict[str, tuple] = {}


def code_lengths(trees: Trees, text: pa.Array) -> np.ndarray:
    """Bits that each language needs for each whole text."""
    if trees.key not in _TABLES:
        _TABLES.clear()
        _TABLES[trees.key] = trees.table(), None
        if _TABLES[trees.key][0] is None:
            _TABLES[trees.key] = None, [trees.lists(k) for k in range(len(trees.langs))]
    table, lists = _TABLES[trees.key]
    data, begin = _bytes(text)
    out = np.zeros((len(text), len(trees.langs)))
    for lo in range(ORDER, len(data), BLOCK):
        hi = min(lo + BLOCK, len(data))
        docs = np.arange(np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, hi, "left"))
        first, end = np.clip(begin[docs] + ORDER, lo, hi) - lo, np.clip(begin[docs + 1], lo, hi) - lo
        if table:
            symbol, index, cost, a = table
            s = symbol[data[lo - ORDER : hi]]
            at = np.zeros(hi - lo, np.int64)
            for j in range(ORDER):
                at *= a
                at += s[j : hi - lo + j]
            at[:] = index[at]
            at *= a
            at += s[ORDER:]
        else:
            grams = _grams(data[lo - ORDER : hi])
        total = np.zeros(hi - lo + 1)  # one language at a time: its size doesn't grow with their number
        for k in range(len(trees.langs)):
            np.cumsum(cost[k][at] if table else listed_costs(lists[k], grams), dtype=np.float64, out=total[1:])
            out[docs, k] += total[end] - total[first]
    return out


def learn(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Trees:
    """Trees from the rows of ``docs(doc_id, text, lang)`` whose lang and text aren't NULL; of rows that repeat a doc_id in a language, the smallest text."""
    use = docs.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    hashed = use.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).distinct().withColumn("salt", F.pmod("hash", F.lit(SALTS)))
    # the first of each class first, so that no task ranks all documents of a language
    for w in (Window.partitionBy("lang", "salt"), Window.partitionBy("lang")):
        hashed = hashed.withColumn("rn", F.row_number().over(w.orderBy("hash", "doc_id"))).where(F.col("rn") <= docs_per_lang)
    # docs_per_lang ids a language at most: small enough to send to every executor
    sample = use.join(F.broadcast(hashed.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    found = sample.select("lang", "text").mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    return Trees(langs, found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int16), found["gram"].to_numpy(np.int64), found["n"].to_numpy(np.int64))


def identify(docs: DataFrame, trees: Trees, key: list[str] | None = None) -> DataFrame:
    """``key`` columns, lang_pred, score and bits (the best language's code length of the whole text).

    A row for each row of ``docs``. ``und`` with score 0 where the text is NULL or has no letter, or nothing was
    learned. The score is the best language's share when each text is as likely as its code is short; of equal
    lengths, the smallest language by code point wins. Extra columns are ignored.
    """
    key = key or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    use = docs.select(*key, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in use.schema if f.name not in ("text", "has_letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            some = batch.column(batch.schema.get_field_index("has_letter")).to_numpy(zero_copy_only=False).astype(bool) & bool(model.langs)
            text = batch.column(batch.schema.get_field_index("text"))
            lang, score, bits = np.full(len(some), "und", object), np.zeros(len(some)), np.zeros(len(some))
            if some.any():
                length = code_lengths(model, text.filter(pa.array(some)))
                best = length.argmin(1)
                least = length[np.arange(len(best)), best]
                lang[some] = np.array(model.langs, object)[best]
                score[some] = 1 / np.exp2(np.maximum(least[:, None] - length, -1000)).sum(1)
                bits[some] = least
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in key] + [pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], names=[*key, "lang_pred", "score", "bits"])

    return use.mapInArrow(run, f"{kinds}, lang_pred string, score double, bits double")


def language_id(docs: DataFrame, held_out_mod: int = 3, held_out: int = 1) -> DataFrame:
    """Learn from the documents that aren't held out and predict all: doc_id, held_out, lang_pred, score, bits.

    A row for each row of ``docs``, repeated ones included. NULL texts and those without a letter are ``und``, and so is
    every text if nothing was learned; an empty table gives no row; of equal code lengths the smallest language by code
    point wins; extra columns are ignored.
    """
    out = crc_mod("doc_id", held_out_mod) == held_out
    return identify(docs.select("doc_id", "text", out.alias("held_out")), learn(docs.where(~out)), ["doc_id", "held_out"])
