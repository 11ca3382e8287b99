"""Token ids as length-delimited binary records.

A record is: length of the payload (8 bytes), masked CRC-32 of those 8 bytes (4), payload, masked CRC-32 of the payload
(4), and a line end (1), so that Spark's text writer can write it to any file system under its commit protocol. The
payload is the doc_id (8 bytes, signed), flags (1: bit 0, no doc_id; bit 1, ids of 4 bytes rather than 2) and the ids.
Numbers are little-endian. A CRC is masked by a rotation of 15 bits and the addition of MASK, as CRCs of data that
contain CRCs are weak. Files are in ascending doc_id order, and a table beside them has every record's place, for
reads in any order.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.llm.common import BATCH_BYTES, checkpoint_dir, coded, mix64, release, ship, sliced

MASK = 0xA282EAD8
#: Bytes of text in a file, about, and records of a file at most.
FILE_BYTES, FILE_RECORDS = 128 << 20, 20_000
#: Distinct parts of text whose ids a worker keeps in a task, about, and from one task to the next at most.
CACHE, CARRIED = 300_000, 150_000
#: Bytes of a part that is kept for later slices at most, and new words that go to the model at once.
KEY_BYTES, TOGETHER = 32, 4096


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), payload, struct.pack("<I", masked(zlib.crc32(payload))), b"\n"))


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and payload of each record of a file; a damaged one raises ValueError."""
    at = 0
    while at < len(data):
        size = data[at : at + 8]
        if len(size) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(zlib.crc32(size)):
            raise ValueError(f"damaged length at byte {at}")
        n = struct.unpack("<Q", size)[0]
        payload = data[at + 12 : at + 12 + n]
        if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(zlib.crc32(payload)):
            raise ValueError(f"damaged record at byte {at}")
        yield at, payload
        at += 17 + n


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return struct.pack("<qB", 0 if doc_id is None else doc_id, (doc_id is None) | wide << 1) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack_from("<qB", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")


def _byte_chars() -> dict[int, str]:
    """The character that byte-level vocabularies have for each byte: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}


#: Marks that end a word and are a pre-token of their own; a word of letters with such marks or none.
_MARKS = r"[^\p{L}\p{N}\p{Z}\p{C}_\s]"
#: A piece that begins with white space, or is a line end before white space or another.
_WHITE = r"\t\f\r \p{Z}\x0B\x1C-\x1F\x{85}"
_ODD = rf"^(\n([\n{_WHITE}]|$)|[{_WHITE}]|$)"


class Encoder:
    """Ids by the tokenizers library, each distinct part of text encoded once.

    Under the byte-level pattern no pre-token goes on over a space that stands before another character than white
    space, nor over a line end between such characters. Texts are cut there into pieces, and pieces that are letters
    and then marks into these two parts. The parts' ids are kept; texts with other white space or with an added
    token, such as <|endoftext|>, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        self.width = None
        model, chars = spec.get("model") or {}, _byte_chars()
        vocab, others = model.get("vocab"), ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
        if self.cuts and model.get("type") == "BPE" and not any(model.get(k) for k in others) and all(c in vocab for c in chars.values()):
            # bytes of each id, the same model between spaces alone, and each byte's character; a line end ends a word
            self.width = np.zeros(max(vocab.values()) + 1, np.int64)
            self.width[list(vocab.values())] = [len(t) for t in vocab]
            self.between = Tokenizer(self.tok.model)
            self.between.pre_tokenizer = CharDelimiterSplit(" ")
            self.codes = np.array([ord(chars[b]) if b != ord("\n") else ord(" ") for b in range(256)], "<u2")
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty((0, 1 + KEY_BYTES // 8), np.uint64)
        self.at, self.flat, self.seen = np.zeros(1, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint32)
        self.hashes, self.slots = np.empty(0, np.uint64), np.empty(0, np.int32)  # in order of hashes

    def thin(self, most: int) -> None:
        """Keep ``most`` parts at most, of those that came again the ones that came most; what they counted halves."""
        least = 2
        while np.count_nonzero(again := self.seen >= least) > most:
            least *= 2
        kept = np.flatnonzero(again & (self.keys[:, 0] <= KEY_BYTES))
        keys, seen, n = self.keys[kept], self.seen[kept] // 2, np.diff(self.at)[kept]
        flat = spread(self.flat, self.at[kept], n)
        self.clear()
        self._store(keys, hashed(keys), flat, n, seen)

    def _store(self, keys: np.ndarray, hashes: np.ndarray, flat: np.ndarray, n: np.ndarray, seen: np.ndarray) -> None:
        begin = len(self.seen)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
        self.flat, self.keys, self.seen = np.concatenate([self.flat, flat]), np.concatenate([self.keys, keys]), np.concatenate([self.seen, seen])
        short = np.flatnonzero(keys[:, 0] <= KEY_BYTES)
        short = short[np.argsort(hashes[short])]
        to = np.searchsorted(self.hashes, hashes[short])
        self.hashes, self.slots = np.insert(self.hashes, to, hashes[short]), np.insert(self.slots, to, begin + short)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, of which each is one pre-token, one after another, and how many each has.

        Many go to the model at once, as its bytes' characters between spaces. Their ids are dealt by the bytes that
        each id stands for.
        """
        size = pc.binary_length(words).to_numpy().astype(np.int64)
        joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar("\n", words.type))[0].as_buffer()
        bare = self.codes[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.between.encode_batch_fast([bare], add_special_tokens=False)[0].ids, np.uint32)
        ends, last = np.cumsum(self.width[ids]), np.cumsum(size)
        upto = np.searchsorted(ends, last) + 1
        if not len(ids) or upto[-1] != len(ids) or (ends[upto - 1] != last).any():
            raise ValueError("the vocabulary's ids don't stand for all bytes of these words")
        return ids, np.diff(upto, prepend=0)

    def _learn(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parts' order here, their ids one after another, and how many each has."""
        easy = np.zeros(len(parts), bool)
        if self.width is not None:
            easy = pc.utf8_is_alpha(pc.utf8_ltrim(parts, " ")).to_numpy(zero_copy_only=False).astype(bool)
        order = np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)])
        words, rows = parts.take(pa.array(order[: easy.sum()])), self._whole(parts.take(pa.array(order[easy.sum() :])).to_pylist())
        found = [self._words(words.slice(i, TOGETHER)) for i in range(0, len(words), TOGETHER)]
        ids = [x for x, _ in found] + [np.fromiter(chain.from_iterable(rows), np.uint32)]
        return order, np.concatenate(ids), np.concatenate([n for _, n in found] + [np.array([len(x) for x in rows], np.int64)])

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where the ids of each part are kept."""
        codes, distinct = coded(parts)
        if len(self.seen) + len(distinct) > CACHE:
            self.thin(CACHE // 2)
        keys = byte_keys(distinct)
        hashes = hashed(keys)
        places = np.full(len(distinct), -1, np.int64)
        if len(self.hashes):
            near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            slot = self.slots[near]
            held = (self.hashes[near] == hashes) & (self.keys[slot] == keys).all(1)
            places[held] = slot[held]
            self.seen[slot[held]] += 1
        new = np.flatnonzero(places < 0)
        if len(new):
            order, flat, n = self._learn(distinct.take(pa.array(new)))
            new = new[order]
            places[new] = len(self.seen) + np.arange(len(new))
            self._store(keys[new], hashes[new], flat, n, np.ones(len(new), np.uint32))
        return places[codes]

    def _pieces(self, pieces: pa.Array, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and where each begins; a spaced piece has a space before it unless a line end does."""
        line = pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False).astype(bool)
        plain = pc.utf8_is_alpha(pieces).to_numpy(zero_copy_only=False).astype(bool)
        other = np.flatnonzero(~plain)
        odd = pieces.take(pa.array(other))
        bare = pc.replace_substring_regex(odd, r"^\n", "")
        split = pc.match_substring_regex(bare, rf"^\p{{L}}+{_MARKS}*$").to_numpy(zero_copy_only=False).astype(bool)
        word = pc.if_else(pa.array(split), pc.replace_substring_regex(bare, rf"{_MARKS}+$", ""), odd)
        marks = pc.if_else(pa.array(split), pc.replace_substring_regex(bare, r"^\p{L}+", ""), "")
        empty = pa.scalar("", pieces.type)
        gap = pc.if_else(pa.array(spaced & ~line), pa.scalar(" ", pieces.type), empty)
        order = np.concatenate([np.flatnonzero(plain), other])
        back = np.argsort(order, kind="stable")
        words = pa.concat_arrays([pieces.take(pa.array(order[: len(order) - len(other)])), word]).take(pa.array(back))
        words = pc.binary_join_element_wise(gap, words, empty)
        with_marks = np.flatnonzero(pc.greater(pc.binary_length(marks), 0).to_numpy(zero_copy_only=False).astype(bool))
        found = self._places(pa.concat_arrays([words, marks.take(pa.array(with_marks)), pa.array(["\n"], pieces.type)]))
        # three parts of a piece: its line end, its word, its marks
        part = np.full((len(pieces), 3), -1, np.int64)
        part[:, 1] = found[: len(pieces)]
        part[other[with_marks], 2] = found[len(pieces) : -1]
        apart = other[split]
        part[apart[line[apart]], 0] = found[-1]
        n = np.where(part >= 0, self.at[part + 1] - self.at[part], 0)
        ids = spread(self.flat, self.at[part].ravel(), n.ravel())
        return ids, np.concatenate(([0], np.cumsum(n.sum(1))))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, none of which is NULL."""
        if not self.cuts:
            return [np.array(x, np.uint32) for x in self._whole(texts.to_pylist())]
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        code, distinct = coded(parts.flatten())
        code, count = code.astype(np.int32), len(distinct)
        code[offsets[:-1]] += count  # a text's first piece has no space before it
        odd = np.concatenate([pc.match_substring_regex(distinct, _ODD).to_numpy(zero_copy_only=False).astype(bool), np.zeros(count, bool)])
        apart = np.add.reduceat(odd[code], offsets[:-1]) > 0 if len(code) else np.zeros(len(texts), bool)
        for token in self.added:
            apart |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False).astype(bool)
        whole = np.flatnonzero(apart)
        used = np.zeros(2 * count, bool)
        used[code] = True
        rest, first = np.flatnonzero(used[:count]), np.flatnonzero(used[count:])
        flat, at = self._pieces(distinct.take(pa.array(np.concatenate([rest, first]))), np.arange(len(rest) + len(first)) < len(rest))
        place = np.zeros(2 * count, np.int32)
        place[np.concatenate([rest, first + count])] = np.arange(len(rest) + len(first))
        place = place[code]
        n = np.diff(at).astype(np.int32)[place]
        ids = spread(flat, at[place], n)
        cut = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[offsets]
        out = [ids[cut[i] : cut[i + 1]] for i in range(len(texts))]
        for i, x in zip(whole.tolist(), self._whole(texts.take(pa.array(whole)).to_pylist()), strict=True):
            out[i] = np.array(x, np.uint32)
        return out


def spread(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``begin`` and have ``n`` elements each, one after another."""
    end = np.cumsum(n, dtype=np.int64)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if max(len(flat), total) < 1 << 31 else np.int64
    return flat[np.repeat((begin - (end - n)).astype(kind), n) + np.arange(total, dtype=kind)]


_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def byte_keys(strings: pa.Array) -> np.ndarray:
    """Length and bytes of each string as a row of numbers, zeros after its end: exact up to KEY_BYTES bytes."""
    strings = strings.cast(pa.large_string())
    out = np.zeros((len(strings), 1 + KEY_BYTES // 8), np.uint64)
    if not len(strings):
        return out
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    at, size = offsets[:-1] - offsets[0], np.diff(offsets)
    data = np.zeros(int(offsets[-1] - offsets[0]) + KEY_BYTES, np.uint8)
    if len(data) > KEY_BYTES:
        data[:-KEY_BYTES] = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    out[:, 0] = size
    for k in range(KEY_BYTES // 8):
        out[:, 1 + k] = eights[at + 8 * k] & _FIRST[np.clip(size - 8 * k, 0, 8)]
    return out


def hashed(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), np.uint64)
    for column in keys.T:
        out = mix64(out ^ column)
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_records(docs: DataFrame, path: str, vocabulary_path: str, end_id: int) -> None:
    """Encode each row's text (NULL: empty), append ``end_id``, and write the records to ``path`` in ascending doc_id order, rows without doc_id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path)
        for batch in sliced(batches, most=BATCH_BYTES):
            ids = enc.encode(batch.column(1).fill_null(""))
            out = [frame(pack(d, np.append(x, np.uint32(end_id))))[:-1] for d, x in zip(batch.column(0).to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
        enc.thin(CARRIED)  # the worker lives on, and may do other work next
        release()

    use = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = use.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(size // FILE_BYTES, min(size // (FILE_BYTES >> 4), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))) + 1
    # rows that share a doc_id, or have none, are dealt by their texts' hashes
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = use.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_RECORDS).option("lineSep", "\n").text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "piece", "k", "offset", "length", "doc_id", "before", "n_tokens", "ids_crc32"]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 7]
    for batch in batches:
        for j in range(batch.num_rows):
            rows, before = [], 0
            for k, (at, payload) in enumerate(frames(batch.column(2)[j].as_py())):
                doc_id, ids = unpack(payload)
                rows.append((batch.column(0)[j].as_py(), batch.column(1)[j].as_py(), k, at, len(payload), doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                before += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)


def index_records(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Read all records, check them, and write the index: file (part, piece), place, length, doc_id, n_tokens, crc."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = r"part-(\d+)-.*?(?:-c(\d+))?(?:\.\w+)*$"
    numbered = files.select(F.regexp_extract("path", name, 1).cast("int").alias("part"), F.coalesce(F.regexp_extract("path", name, 2).try_cast("int"), F.lit(0)).alias("piece"), "content")
    numbered.mapInArrow(_read, "part int, piece int, k long, offset long, length long, doc_id long, before long, n_tokens long, ids_crc32 long").write.parquet(index_path)
    return spark.read.parquet(index_path)


def with_starts(index: DataFrame) -> DataFrame:
    """The index with start, the ids of all records before: a prefix sum over files, of which each has one row."""
    files = index.groupBy("part", "piece").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return index.join(files.select("part", "piece", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base")), ["part", "piece"]).withColumn("start", F.col("base") + F.col("before"))


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """The index's records in an order that only ``seed`` decides, as a loader would read them: order, part, piece, offset, length."""
    return index.select(F.xxhash64(F.lit(seed), "part", "piece", "k").alias("order"), "part", "piece", "offset", "length", "doc_id").orderBy("order", "part", "piece", "offset")


def token_output(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the records and their index, read them back: doc_id, start, n_tokens, ids_crc32, and each record's part, piece, offset, length.

    A row for each row of ``docs``, repeated rows included; NULL and empty texts have the end id alone. Rows that
    share a doc_id follow in order of their texts' hashes. Without ``path`` the files go to the shared checkpoint folder.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    write_records(docs, f"{path}/data", vocabulary_path or vocabulary(), end_id)
    found = with_starts(index_records(spark, f"{path}/data", f"{path}/index"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", "part", "piece", "offset", "length")
