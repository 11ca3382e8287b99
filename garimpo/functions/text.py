"""Portuguese text analysis as Column expressions, with an Arrow UDF for the full stemmer."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.wordlists import STOPWORDS, SUFFIXES

SHORTEST, LONGEST, LONGEST_NUMBER, SHORTEST_STEM = 2, 40, 8, 3
TOKEN_RE = r"[\p{L}\p{N}_]+"


def _accented() -> tuple[str, str]:
    """Latin letters that decompose to a base letter and marks, and these base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<") and all(unicodedata.category(x) == "Mn" for x in unicodedata.normalize("NFD", chr(c))[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accented()
#: Input has no accents any more, so endings with accents can't match.
STEM_RE = f"^(.{{{SHORTEST_STEM},}}?)(?:" + "|".join(s for s in SUFFIXES if s.isascii()) + ")$"
STOP = sorted({s for s in STOPWORDS if s.isascii()})


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_accents(text: Column | str) -> Column:
    return F.regexp_replace(F.translate(_c(text), ACCENTED, PLAIN), r"\p{Mn}", "")


def is_word(word: Column) -> Column:
    return (F.length(word) >= SHORTEST) & (F.length(word) <= LONGEST) & ((F.length(word) <= LONGEST_NUMBER) | ~word.rlike(rf"^\p{{Nd}}{{{LONGEST_NUMBER + 1},}}$"))


def words(text: Column | str) -> Column:
    """Lower-case words of 2 to 40 characters, without numbers of more than 8 digits."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(f"({TOKEN_RE})"), F.lit(1))
    return F.filter(found, is_word)


def stem(word: Column) -> Column:
    """The word without its longest listed ending, if three characters are left."""
    out, ascii_endings = word, [s for s in SUFFIXES if s.isascii()]
    for k in sorted({len(s) for s in ascii_endings}):  # the last test comes first: the longest ending
        held = (F.length(word) >= SHORTEST_STEM + k) & F.substring(word, -k, k).isin(sorted({s for s in ascii_endings if len(s) == k}))
        out = F.when(held, F.substring(word, F.lit(1), F.length(word) - k)).otherwise(out)
    return out


def plain_words(text: Column | str) -> Column:
    """The words with their accents off. A letter stays one letter, so that this can be done in the whole text; words have no marks."""
    found = F.regexp_extract_all(F.translate(F.lower(_c(text)), ACCENTED, PLAIN), F.lit(f"({TOKEN_RE})"), F.lit(1))
    return F.filter(found, is_word)


def term_rows(docs: DataFrame, text: Column, stopwords: bool = True, stemming: bool = True) -> DataFrame:
    """doc_id, pos, term: the terms of each text as rows, with ascending places. Unlike array functions, all of it is compiled."""
    found = F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(f"({TOKEN_RE})"), F.lit(1))
    rows = docs.select("doc_id", F.posexplode(found).alias("pos", "word")).where(is_word(F.col("word")))
    if stopwords:
        rows = rows.where(~F.col("word").isin(STOP))
    return rows.select("doc_id", "pos", (stem(F.col("word")) if stemming else F.col("word")).alias("term")).where(F.length("term") >= SHORTEST)


def terms(text: Column | str, stopwords: bool = True, stemming: bool = True) -> Column:
    """Terms of a text in order: words, accents off, stop words out, stems of two characters or more."""
    found = plain_words(text)
    if stopwords:
        found = F.filter(found, lambda w: ~w.isin(STOP))
    if stemming:
        found = F.transform(found, stem)
    return F.filter(found, lambda w: F.length(w) >= SHORTEST)
