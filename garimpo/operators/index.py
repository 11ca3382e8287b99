"""Inverted index and BM25 search: aggregates, joins and top-k.

The corpus is ``docs(doc_id, url, title, text, domain, is_product, category)``. Terms get numbers in order of first
occurrence over documents by id; the numbers come from ranges of equal size and their offsets, not from one task.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.functions import stemmer
from garimpo.functions import text as X
from garimpo.sources import scratch

K1, B = 1.5, 0.75
SHARDS, SHARD_DIRS = 256, 16
TITLE_WEIGHT, TITLE_SHOWN, SHORTEST_TEXT = 3, 200, 50
#: A value of ``stemming`` that takes the paper's stemmer instead of the list of endings, and its name in meta.
PAPER = "rslp"


@dataclass
class Index:
    meta: DataFrame
    vocab: DataFrame
    docs: DataFrame
    postings: DataFrame
    stopwords: bool = True
    stemming: bool | str = True


def occurrences(docs: DataFrame, stopwords: bool = True, stemming: bool | str = True) -> DataFrame:
    """doc_id, term, tf and first place of each term of each document: the title three times, then the text.

    A document's terms meet in the partial aggregate, so that the shuffle has a row for each distinct term. The paper's
    stemmer, in Python, gets each distinct word of a document once; what it makes equal meets in a second aggregate.
    """
    text = F.concat(F.repeat(F.concat(F.coalesce("title", F.lit("")), F.lit(" ")), TITLE_WEIGHT), F.coalesce("text", F.lit("")))
    found = X.term_rows(docs, text, stopwords, stemming is True).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("pos"))
    if stemming != PAPER:
        return found
    stems = found.withColumn("term", stemmer.stem_udf()("term")).where(F.length("term") >= X.SHORTEST)
    return stems.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.min("pos").alias("pos"))


def lengths(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def vocabulary(found: DataFrame) -> DataFrame:
    """term, id, df: ids count up over the first occurrences by document and place."""
    terms = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return numbered(terms, [F.col("first.doc_id"), F.col("first.pos"), F.col("term")], "id").select("term", "id", "df")


def numbered(df: DataFrame, order: list[Column], name: str, parts: int = 64) -> DataFrame:
    """A number from 0 on by ``order``: rows get a number within ranges of the first key, and each range's offset.

    The ranges are cut at estimated quantiles, once, so that they are of about equal size; their cuts, ``parts`` numbers,
    come to the driver. Where they lie doesn't change the numbers.
    """
    first = order[0].cast("long")
    cuts = df.agg(F.percentile_approx(first, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    place = F.lit(0)
    for cut in sorted(set(cuts)):
        place = place + (first > cut).cast("int")
    placed = df.withColumn("_part", F.coalesce(place, F.lit(0)))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    ranked = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    # a row for each of ``parts`` ranges
    return ranked.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_rn") - 1).drop("_part", "_base", "_rn")


def build(docs: DataFrame, stopwords: bool = True, stemming: bool | str = True, shortest: int = SHORTEST_TEXT) -> Index:
    """Meta, vocabulary, documents and postings of the documents whose text has over ``shortest`` characters and a term.

    The texts are read once: terms and vocabulary are written to the shared scratch folder, and all tables come from there.
    """
    spark, path = docs.sparkSession, temporary(scratch.folder(docs.sparkSession))
    docs = docs.where(F.length("text") > shortest)
    occurrences(docs, stopwords, stemming).write.parquet(f"{path}/occurrences")
    found = spark.read.parquet(f"{path}/occurrences")
    vocabulary(found).write.parquet(f"{path}/vocab")
    vocab = spark.read.parquet(f"{path}/vocab")
    shown = docs.join(lengths(found), "doc_id").select("doc_id", "url", F.substring("title", 1, TITLE_SHOWN).alias("title"), "domain", "dl", "is_product", "category")
    postings = found.join(vocab.select("term", "id"), "term").select(shard("id").alias("shard"), F.col("id").alias("term_id"), "doc_id", "tf")
    return Index(meta(found, shown, stopwords, stemming), vocab.withColumn("raw", F.col("term")), shown, postings, stopwords, stemming)


def shard(term_id: Column | str) -> Column:
    return F.pmod(term_id, F.lit(SHARDS)).cast("int")


def meta(found: DataFrame, docs: DataFrame, stopwords: bool = True, stemming: bool | str = True) -> DataFrame:
    totals = found.agg(F.count(F.lit(1)).alias("total_postings"), F.countDistinct("term").alias("total_terms"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"), F.countDistinct("doc_id").alias("total_docs"))
    return totals.select("total_docs", "total_terms", "total_postings", F.round(F.col("tokens") / F.greatest("total_docs", F.lit(1)), 2).alias("avg_dl"), F.lit(stopwords).alias("use_stopwords"), F.lit(PAPER if stemming == PAPER else "suffix" if stemming else "none").alias("stemmer"))


def save(index: Index, path: str) -> None:
    """Four Parquet tables. Postings lie in SHARD_DIRS folders by shard and are sorted by shard and term, the vocabulary is sorted by term: a search opens the folders, files and row groups that have its terms."""
    index.meta.write.mode("overwrite").parquet(f"{path}/meta")
    index.vocab.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocab")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    dealt = index.postings.withColumn("bucket", F.pmod("shard", F.lit(SHARD_DIRS)))
    # terms of a folder are dealt by ranges, so that a file has few of them; a very common term fills several files
    dealt.repartitionByRange("bucket", "shard", "term_id", "doc_id").sortWithinPartitions("bucket", "shard", "term_id", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def load(spark: SparkSession, path: str) -> Index:
    """The index at ``path``; missing tables are empty ones."""
    from garimpo.schemas import schema

    fs = spark._jvm.org.apache.hadoop.fs
    tables = {}
    for name in ("meta", "vocab", "docs", "postings"):
        at = fs.Path(f"{path}/{name}")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        tables[name] = spark.read.parquet(f"{path}/{name}") if there else spark.createDataFrame([], schema(name))
    first = tables["meta"].first()
    return Index(**tables, stopwords=first is None or first["use_stopwords"], stemming=first is None or {PAPER: PAPER, "none": False}.get(first["stemmer"], True))


def is_ready(index: Index) -> bool:
    return all(df.limit(1).count() for df in (index.meta, index.vocab, index.docs))


def query_terms(spark: SparkSession, query: str, index: Index) -> list[str]:
    """The distinct terms of a query."""
    found = spark.range(1).select(F.array_distinct(X.terms(F.lit(query), index.stopwords, index.stemming is True))).first()[0]
    if index.stemming != PAPER:
        return found
    return [t for t in dict.fromkeys(map(stemmer.stem, found)) if len(t) >= X.SHORTEST]


def known_terms(index: Index, terms: list[str]) -> list[Row]:
    """term, id and df of those of a query's terms that the vocabulary has."""
    return index.vocab.where(F.col("term").isin(terms)).select("term", "id", "df").collect() if terms else []


def postings_of(index: Index, ids: list[int]) -> DataFrame:
    """Postings of the terms with these ids. The ids stand in the plan, so that folders and row groups of other shards aren't read."""
    shards = sorted({k % SHARDS for k in ids})
    some = F.col("shard").isin(shards) & F.col("term_id").isin(sorted(ids))
    if "bucket" in index.postings.columns:
        some &= F.col("bucket").isin(sorted({k % SHARD_DIRS for k in shards}))
    return index.postings.where(some if ids else F.lit(False))


def search(index: Index, query: str, top_k: int = 10, domain: str | None = None) -> DataFrame:
    """rank, doc_id, score (4 decimals), url, title, domain, is_product and category of the ``top_k`` best documents by BM25.

    Unknown terms count for nothing; a query without known terms has no rows; ``domain`` keeps documents whose domain
    contains it, while frequencies stay those of the corpus; equal scores go by doc_id. A query's terms, a few rows of
    the vocabulary and of meta, come to the driver.
    """
    known = known_terms(index, query_terms(index.docs.sparkSession, query, index))
    corpus = index.meta.select("total_docs", "avg_dl").first() if known else None
    idf = F.lit(None).cast("double")
    for r in known:
        idf = F.when(F.col("term_id") == r.id, math.log((corpus.total_docs - r.df + 0.5) / (r.df + 0.5) + 1)).otherwise(idf)
    docs = index.docs.where(F.contains("domain", F.lit(domain))) if domain else index.docs
    hits = postings_of(index, [r.id for r in known]).select("doc_id", "tf", idf.alias("idf"), F.lit(corpus.avg_dl if corpus else 1.0).alias("avg_dl")).join(docs.select("doc_id", "dl"), "doc_id")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    best = hits.groupBy("doc_id").agg(F.sum(part).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(top_k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")))
    return ranked.join(docs, "doc_id").select("rank", "doc_id", F.round("score", 4).alias("score"), "url", "title", "domain", "is_product", "category")


def matching(index: Index, all_of: str = "", any_of: str = "", none_of: str = "") -> DataFrame:
    """doc_ids of boolean retrieval: with every term of ``all_of``, some of ``any_of`` and none of ``none_of``."""
    spark = index.docs.sparkSession

    def having(terms: list[str]) -> DataFrame:
        return postings_of(index, [r.id for r in known_terms(index, terms)])

    out = index.docs.select("doc_id")
    if all_of:
        wanted = query_terms(spark, all_of, index)
        out = out.join(having(wanted).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)), "doc_id", "left_semi")
    if any_of:
        out = out.join(having(query_terms(spark, any_of, index)), "doc_id", "left_semi")
    if none_of:
        out = out.join(having(query_terms(spark, none_of, index)), "doc_id", "left_anti")
    return out


def top_terms(index: Index, n: int = 50) -> DataFrame:
    return index.vocab.select("term", "id", "df").orderBy(F.col("df").desc(), "id").limit(n)


def df_statistics(index: Index) -> DataFrame:
    """Terms, hapaxes and their percentage, and the df at ranks floor(p n) of the ascending order.

    The ranks are found in the histogram of df, which has far fewer rows than the vocabulary.
    """
    hist = index.vocab.groupBy("df").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("df")
    run = hist.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(p * F.col("total")), F.col("df")))
    one = F.coalesce(F.max(F.when(F.col("df") == 1, F.col("n"))), F.lit(0))
    return run.agg(F.coalesce(F.max("total"), F.lit(0)).alias("terms"), at(F.lit(0.5)).alias("df_p50"), at(F.lit(0.9)).alias("df_p90"), at(F.lit(0.99)).alias("df_p99"), one.alias("hapax"), F.round(one * 100 / F.max("total"), 1).alias("hapax_pct"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The smallest doc_id of each text, and how many rows have it."""
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def temporary(path: str) -> str:
    return f"{path}/index-{uuid.uuid4().hex}"
