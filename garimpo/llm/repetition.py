"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.llm.common import coded, mix64, rows_of, sliced, split_words, sums

#: n-gram length: most hundredths of a text's word characters that may lie in n-grams found twice or more in it.
NGRAM_LIMITS = {5: 40, 7: 35, 10: 30}
#: Most hundredths of a text's line characters that may lie in lines equal to an earlier line.
LINE_LIMIT = 30
#: Most hundredths of the words that may lie in repeated three-word windows, and fewest words.
BASE_LIMIT, BASE_WORDS = 50, 50

SYMBOLS = "#*$%&|<>"
_STEP = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in NGRAM_LIMITS)


def repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each key is found twice or more in its row."""
    keys = mix64(keys + rows.astype(np.uint64) * _STEP)
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered_words(codes: np.ndarray, offsets: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Whether each word lies in an n-word window that its row has twice or more."""
    total = len(codes)
    out = np.zeros(total, bool)
    if total < n:
        return out
    key = np.zeros(total - n + 1, np.uint64)
    for j in range(n):
        key = (key + codes[j : total - n + 1 + j].astype(np.uint64) + np.uint64(1)) * _STEP
        key ^= key >> np.uint64(29)
    inside = rows[: total - n + 1] == rows[n - 1 :]
    at = np.flatnonzero(inside)
    found = at[repeated(key[at], rows[at])]
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + n, -1)
    return np.cumsum(edge[:-1]) > 0


def line_figures(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of the text, their characters, and the characters of all lines with a word."""
    parts = pc.split_pattern(text, "\n")
    lines, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    rows = rows_of(offsets)
    codes, distinct = coded(lines)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(distinct)), 0).to_numpy(zero_copy_only=False)[codes].astype(bool)
    chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    pair = rows * (len(distinct) + 1) + codes
    first = np.zeros(len(pair), bool)
    first[np.unique(pair, return_index=True)[1]] = True
    again = full & ~first
    return sums(again, offsets), sums(np.where(again, chars, 0), offsets), sums(np.where(full, chars, 0), offsets)


def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch's columns, and each text's figures behind them."""
    for batch in sliced(batches):
        text = batch.column(batch.schema.get_field_index("text")).fill_null("")
        offsets, words = split_words(text)
        codes, distinct = coded(words)
        rows = rows_of(offsets)
        chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else np.empty(0, np.int64)
        symbols = np.zeros(len(text), np.int64)
        for s in SYMBOLS:
            symbols += pc.count_substring(text, s).to_numpy(zero_copy_only=False)
        dup_lines, dup_line_chars, line_chars = line_figures(text)
        out = [np.diff(offsets), sums(chars, offsets), symbols, dup_lines, sums(covered_words(codes, offsets, rows, 3), offsets), dup_line_chars, line_chars]
        out += [sums(np.where(covered_words(codes, offsets, rows, n), chars, 0), offsets) for n in NGRAM_LIMITS]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(x, pa.int64()) for x in out], names=batch.schema.names + names)


def repetition(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, the figures of each whole text, ``base_failed`` and ``kept``.

    A row for each row of ``docs``; repeated rows count alone. A NULL or empty text has no word and fails the base
    rule. ``kept``: the base rule holds, and for each length of NGRAM_LIMITS and for lines the repeated characters
    stay within the limit. Extra columns pass through; those with a figure's name are left out.
    """
    made = {x.split()[0] for x in SCHEMA.split(", ")} | {"base_failed", "kept"}
    use = docs.select(*[f"`{c}`" for c in docs.columns if c not in made])
    found = use.mapInArrow(figures, T.StructType(use.schema.fields + T._parse_datatype_string(SCHEMA).fields))
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_LIMIT * F.col("n_words"))
    good = 100 * F.col("dup_line_chars") <= LINE_LIMIT * F.col("line_chars")
    for n, most in NGRAM_LIMITS.items():
        good &= 100 * F.col(f"dup_chars_{n}") <= most * F.col("word_chars")
    return found.withColumn("base_failed", base).withColumn("kept", ~base & good)
