"""The given tables as the engine's: Spark frames, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import url as U
from garimpo.functions import html as H


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values: list) -> str:
    return ", ".join(repr_sql(v) for v in values)


def repr_sql(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as indexed pages: source is the domain, and there are no titles."""
    return t(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("url"), F.lit("").alias("title"), "text", F.col("source").alias("domain"), F.lit(False).alias("is_product"), F.lit(None).cast("string").alias("category"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", U.domain("url").alias("domain"), H.title("html").alias("title"), (F.col("page_id") % 3 == 0).alias("is_product_page"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as products of pages."""
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 300).alias("page_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice") * (1 + F.col("p_partkey") % 11)).alias("price"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("category"), F.col("p_brand").alias("store"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a crawl's log."""
    return t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("host"), F.col("user_id").cast("string").alias("domain"), F.col("event_type").alias("status"), F.col("ts").alias("at"), F.col("value").cast("int").alias("priority"), F.sha2(F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 40).cast("string")), 256).alias("url_hash"), "value")


HOST_SQL = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^([^:/?#]+)://([^/?#]*)', 2)), '^.*@', ''), '(:\\d*)?\\.?$', '')"
_TWO = f"(split_part(h, '.', -2) || '.' || split_part(h, '.', -1)) IN ({sql_list(U.TWO_LABELS)})"
DOMAIN_SQL = f"CASE WHEN h = '' THEN regexp_extract(url, '^([^/?#.]*)', 1) || '.' WHEN {_TWO} THEN regexp_extract(h, '([^.]*\\.)?[^.]*\\.[^.]*$') ELSE regexp_extract(h, '([^.]*\\.)?[^.]*$') END"
TITLE_SQL = "nullif(substr(trim(regexp_replace({0}, '[\\s ]+', ' ', 'g')), 1, 512), '')"


def unescape_sql(x: str) -> str:
    for name, char in H.ENTITIES.items():
        x = f"replace({x}, {repr_sql(name)}, {repr_sql(char)})"
    return x


PAGES_SQL = f"""pg AS (SELECT page_id AS id, url, {DOMAIN_SQL} AS domain, {TITLE_SQL.format(unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title, page_id % 3 = 0 AS is_product_page
  FROM (SELECT *, {HOST_SQL} AS h FROM pages))"""
PRODUCTS_SQL = "pr AS (SELECT p_partkey AS id, p_partkey % 300 AS page_id, p_name AS name, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice * (1 + p_partkey % 11) END AS price, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS category, p_brand AS store FROM part)"
REQUESTS_SQL = "rq AS (SELECT event_id AS id, event_id AS seq, user_id::VARCHAR AS host, user_id::VARCHAR AS domain, event_type AS status, ts AS ats, trunc(value)::INT AS priority, sha256(user_id::VARCHAR || '/' || (event_id % 40)::VARCHAR) AS url_hash, value FROM events)"
