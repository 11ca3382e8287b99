"""Text analysis, index and search over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import text as X
from garimpo.operators import index as I
from garimpo.plans.views import corpus, sql_list, t
from garimpo.sources import scratch

QUERY = "the ou des"
SEARCHES = ["the of and", "die und der", "que los de en"]

W = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 2 AND length(w) <= 40 AND NOT regexp_full_match(w, '\p{Nd}{9,}'))"
A = f"list_transform({W}, lambda w: strip_accents(w))"
S = f"list_filter({A}, lambda w: w NOT IN ({sql_list(X.STOP)}))"
STEM = "regexp_replace(w, '" + X.STEM_RE + "', '\\1')"
TERMS = f"list_filter(list_transform({S}, lambda w: {STEM}), lambda w: length(w) >= 2)"
OCC = f"""d AS (SELECT doc_id, source, {TERMS} AS ts FROM documents WHERE length(text) > {I.SHORTEST_TEXT}),
e AS (SELECT doc_id, source, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM d),
o AS (SELECT doc_id, any_value(source) AS source, term, count(*) AS tf, min(pos) AS pos FROM e GROUP BY doc_id, term),
v AS (SELECT term, df, row_number() OVER (ORDER BY fd, fp) - 1 AS id FROM (SELECT term, count(*) AS df, min(doc_id) AS fd, arg_min(pos, doc_id) AS fp FROM o GROUP BY term)),
l AS (SELECT doc_id, any_value(source) AS source, sum(tf) AS dl FROM o GROUP BY doc_id),
m AS (SELECT count(DISTINCT doc_id) AS total_docs, count(DISTINCT term) AS total_terms, count(*) AS total_postings, round(sum(tf) / greatest(count(DISTINCT doc_id), 1), 2) AS avg_dl FROM o)"""


def _md5(words) -> object:
    return F.md5(F.array_join(words, " ").cast("binary"))


def o51a_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.words("text")
    return t(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n"), _md5(w).alias("digest"))


def o51b_strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(X.strip_accents("text").cast("binary")).alias("digest"))


def o51c_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.terms("text", stemming=False)
    return t(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n"), _md5(w).alias("digest"))


def o51d_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.terms("text")
    return t(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n"), _md5(w).alias("digest"))


def o51f_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(X.terms(F.lit("Placas de Vídeo RTX 4070 computadores rapidamente")))).toDF("pos", "term")


def o54j_document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.occurrences(corpus(spark, sf_dir).where(F.length("text") > I.SHORTEST_TEXT))
    return found.groupBy("doc_id").agg(F.sum("tf").alias("dl"), F.count(F.lit(1)).alias("terms"), F.max("tf").alias("most"))


_SAVED: dict[tuple[str, str], str] = {}


def saved(spark: SparkSession, sf_dir: str, again: bool = False) -> I.Index:
    """The index of a folder's documents, built and written once in a session, read from its files."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if again or key not in _SAVED or not scratch.exists(spark, _SAVED[key]):
        path = I.temporary(scratch.folder(spark))
        I.save(I.build(corpus(spark, sf_dir)), path)
        _SAVED[key] = path
    return I.load(spark, _SAVED[key])


def o54k_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build(corpus(spark, sf_dir)).vocab.select("term", "id", "df")


def o54l_index_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, sf_dir).meta.select("total_docs", "total_terms", "total_postings", "avg_dl")


def o54m_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.top_terms(saved(spark, sf_dir))


def o54m_df_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.df_statistics(saved(spark, sf_dir))


def o18_index_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index built, written, read again, and its postings counted by shard."""
    return saved(spark, sf_dir, again=True).postings.groupBy("shard").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"), F.countDistinct("term_id").alias("terms"))


def o57_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.search(saved(spark, sf_dir), QUERY, 10).select("rank", "doc_id", "score", "domain")


def o57_bm25_domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.search(saved(spark, sf_dir), "the and die", 5, domain="src1").select("rank", "doc_id", "score", "domain")


def o52c_term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = saved(spark, sf_dir)
    known = I.known_terms(index, I.query_terms(spark, QUERY, index))
    names = spark.createDataFrame([(r.id, r.term) for r in known], "term_id long, term string")
    # a query's few terms
    return I.postings_of(index, [r.id for r in known]).join(F.broadcast(names), "term_id").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tokens"))


def o71_boolean_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.matching(saved(spark, sf_dir), all_of="the and", any_of="with from", none_of="die")


def o72_distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.distinct_texts(t(spark, sf_dir, "documents"))


def _digest(words: str) -> str:
    return f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {words} AS w FROM documents)"


def _search(terms: list[str], k: int, where: str = "true") -> str:
    return f"""WITH {OCC},
s AS (SELECT o.doc_id, any_value(o.source) AS domain, sum(ln((total_docs - df + 0.5) / (df + 0.5) + 1) * tf * (1.5 + 1) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl))) AS score
  FROM o JOIN v USING (term) JOIN l USING (doc_id), m WHERE term IN ({sql_list(terms)}) AND {where} GROUP BY o.doc_id)
SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, round(score, 4) AS score, domain FROM s ORDER BY score DESC, doc_id LIMIT {k}"""


QUERIES = {f.__name__: f for f in (o51a_tokens, o51b_strip_accents, o51c_stopwords, o51d_stems, o51f_query_terms, o54j_document_lengths, o54k_vocabulary, o54l_index_meta, o54m_top_terms, o54m_df_statistics, o18_index_shards, o57_bm25_search, o57_bm25_domain_filter, o52c_term_postings, o71_boolean_search, o72_distinct_texts)}
ORACLES = {
    "o51a_tokens": _digest(W),
    "o51b_strip_accents": "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents",
    "o51c_stopwords": _digest(S),
    "o51d_stems": _digest(TERMS),
    "o51f_query_terms": f"SELECT unnest(range(len(w)))::INT AS pos, unnest(w) AS term FROM (SELECT {TERMS} AS w FROM (SELECT 'Placas de Vídeo RTX 4070 computadores rapidamente' AS text))",
    "o54j_document_lengths": f"WITH {OCC} SELECT doc_id, sum(tf)::BIGINT AS dl, count(*) AS terms, max(tf) AS most FROM o GROUP BY doc_id",
    "o54k_vocabulary": f"WITH {OCC} SELECT term, id, df FROM v",
    "o54l_index_meta": f"WITH {OCC} SELECT * FROM m",
    "o54m_top_terms": f"WITH {OCC} SELECT term, id, df FROM v ORDER BY df DESC, id LIMIT 50",
    "o54m_df_statistics": f"""WITH {OCC}, r AS (SELECT df, row_number() OVER (ORDER BY df) - 1 AS k, count(*) OVER () AS n FROM v)
SELECT count(*) AS terms, max(df) FILTER (k = floor(0.5 * n)) AS df_p50, max(df) FILTER (k = floor(0.9 * n)) AS df_p90, max(df) FILTER (k = floor(0.99 * n)) AS df_p99, count(*) FILTER (df = 1) AS hapax, round(count(*) FILTER (df = 1) * 100.0 / count(*), 1) AS hapax_pct FROM r""",
    "o18_index_shards": f"WITH {OCC} SELECT (id % 256)::INT AS shard, count(*) AS postings, sum(tf)::BIGINT AS tokens, count(DISTINCT id) AS terms FROM o JOIN v USING (term) GROUP BY 1",
    "o57_bm25_search": _search(["the", "des"], 10),
    "o57_bm25_domain_filter": _search(["the", "and", "die"], 5, "contains(o.source, 'src1')"),
    "o52c_term_postings": f"WITH {OCC} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tokens FROM o WHERE term IN ('the', 'des') GROUP BY term",
    "o71_boolean_search": f"""WITH {OCC} SELECT doc_id FROM l WHERE doc_id IN (SELECT doc_id FROM o WHERE term IN ('the', 'and') GROUP BY doc_id HAVING count(*) = 2)
AND doc_id IN (SELECT doc_id FROM o WHERE term IN ('with', 'from')) AND doc_id NOT IN (SELECT doc_id FROM o WHERE term = 'die')""",
    "o72_distinct_texts": "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
}
