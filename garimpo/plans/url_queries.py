"""URL functions over the pages' addresses and over addresses of the shops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import stores as ST
from garimpo.functions import url as U
from garimpo.operators import frontier as FR
from garimpo.plans.views import DOMAIN_SQL, HOST_SQL, repr_sql, sql_list, t

CASES = [
    "https://www.kabum.com.br/produto/123456/ssd-kingston-480gb",
    "https://www.kabum.com.br/hardware/processadores",
    "https://www.kabum.com.br/hardware?facet_filters=abc",
    "HTTPS://WWW.KABUM.COM.BR/Produto/99/",
    "https://www.kabum.com.br/carrinho",
    "https://www.kabum.com/produto/1",
    "https://lista.mercadolivre.com.br/placa-rtx",
    "https://produto.mercadolivre.com.br/MLB-123456789-notebook",
    "https://www.mercadolivre.com.br/notebook-lenovo-ideapad/p/MLB19283746?utm_source=x&ref=y",
    "https://click1.mercadolivre.com.br/mclics/clicks",
    "https://www.amazon.com.br/dp/B08XYZ1234/ref=sr_1_1?keywords=a+b&b=2&a=1",
    "https://www.amazon.com.br/s?k=ssd+nvme",
    "https://www.amazon.com.br/gp/cart/view.html",
    "https://www.magazineluiza.com.br/ssd/p/abc123/in/hdip/",
    "https://www.amazon.com.br/manual.PDF",
    "http://blog.example.org/c/fotos",
    "ftp://www.kabum.com.br/produto/7",
    "javascript:void(0)",
]


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, u, k % 5 * 6) for k, u in enumerate(CASES)], "k int, url string, depth int")


def o21_normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("url").union(cases(spark).select("url").where("url like '%://%'")).select("url", U.normalize("url").alias("normalized"))


def o22_hash_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", U.hash_url("url").alias("url_hash"))


def o23_extract_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("url").union(cases(spark).select("url")).select("url", U.domain("url").alias("domain"))


def o24_store_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A broadcast join with the shops, of which there are a handful."""
    made = cases(spark).withColumn("domain", U.domain("url"))
    return made.join(F.broadcast(ST.frame(spark).select("domain", "key")), "domain", "left").select("k", "domain", F.col("key").alias("store"))


def o25_store_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).select("k", U.store_mentioned("url").alias("store"))


def o26_is_allowed_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).select("k", U.is_allowed("url").alias("allowed"))


def o27_is_product_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).select("k", U.is_product_url("url").alias("product"))


def o28_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).select("k", U.priority("url", "depth").alias("priority"))


def o29_is_listing_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("url").union(cases(spark).select("url")).select("url", U.is_listing_url("url").alias("listing"))


def o30_product_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).select("k", U.has_product_pattern("url").alias("product"))


def o31_slug_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).select("k", U.slug_name("url").alias("name"))


def o32_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("url").union(cases(spark).select("url")).select("url", U.netloc("url").alias("netloc"), U.price_host("url").alias("price_host"))


def o33_store_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).select("k", U.store_label(U.domain("url")).alias("label"))


def o34_url_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).where("url like '%://%'").select("k", U.url_item("url", "depth").alias("i")).select("k", "i.url", "i.url_hash", "i.domain", "i.depth", "i.priority")


def o08_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.seeds(spark).groupBy("key").agg(F.count(F.lit(1)).alias("seeds"), F.min("priority").alias("priority"))


def o53_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark).select("k", FR.delay_of("url").alias("delay"))


_C = "c(k, url, depth) AS (VALUES " + ", ".join(f"({k}, {repr_sql(u)}, {k % 5 * 6})" for k, u in enumerate(CASES)) + ")"
_U = f"{_C}, u AS (SELECT url FROM pages UNION ALL SELECT url FROM c)"
_D = f"{_C}, d AS (SELECT *, {DOMAIN_SQL} AS domain FROM (SELECT *, {HOST_SQL} AS h FROM c))"


def by_store(pick, other: str) -> str:
    return "CASE domain " + " ".join(f"WHEN {repr_sql(s.domain)} THEN {pick(s)}" for s in ST.STORES) + f" ELSE {other} END"


def _match(patterns: list[str], col: str = "url") -> str:
    return f"regexp_matches({col}, {repr_sql('(?i)' + '|'.join(patterns))})"


def normalize_sql(src: str) -> str:
    """url and normalized of the rows of ``src``."""
    return f"""n0 AS (SELECT url, regexp_replace(url, '#.*$', '') AS x FROM {src}),
n1 AS (SELECT url, lower(regexp_extract(x, '^([^:/?#]+)://([^/?#]*)([^?#]*)', 1)) AS sch, lower(regexp_extract(x, '^([^:/?#]+)://([^/?#]*)([^?#]*)', 2)) AS net,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(x, '^([^:/?#]+)://([^/?#]*)([^?#]*)', 3), ';[^/]*$', ''), '/+$', ''), '/ref=[^/]*', '', 'g'), '/+$', '') AS path,
  list_filter(string_split(CASE WHEN contains(x, '?') THEN regexp_replace(x, '^[^?]*\\?', '') ELSE '' END, '&'), lambda p: p <> '') AS ps FROM n0),
n2 AS (SELECT *, list_filter(list_transform(ps, lambda p: {{'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'v': url_decode(replace(CASE WHEN contains(p, '=') THEN regexp_replace(p, '^[^=]*=', '') ELSE '' END, '+', ' '))}}), lambda p: lower(p.k) NOT IN ({sql_list(U.TRACKING)})) AS qs FROM n1),
n3 AS (SELECT *, array_to_string(list_transform(list_sort(list_filter(qs, lambda p, i: list_position(list_transform(qs, lambda q: q.k), p.k) = i)), lambda p: p.k || '=' || p.v), '&') AS q FROM n2),
nn AS (SELECT url, sch || '://' || net || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS normalized FROM n3)"""


_LISTING = "regexp_matches(lower(url), " + repr_sql("|".join(U.LISTING_PARTS)) + ")"
PRIORITY_SQL = by_store(lambda s: f"CASE WHEN {_match(s.product_patterns)} THEN 100 WHEN url IN ({sql_list(s.seed_urls)}) THEN 90 WHEN {_LISTING} THEN 80 ELSE greatest(10, 50 - 2 * depth) END", "0")
ALLOWED_SQL = f"({by_store(lambda s: f'{str(s.enabled).lower()} AND NOT {_match(s.ignore_patterns)}', 'false')}) AND regexp_matches(url, '^https?://') AND NOT regexp_matches(lower(url), {repr_sql('[.](' + '|'.join(U.FILE_ENDINGS) + ')$')})"
_NET = "lower(regexp_extract(url, '^([^:/?#]+)://([^/?#]*)', 2))"

QUERIES = {f.__name__: f for f in (o21_normalize_url, o22_hash_url, o23_extract_domain, o24_store_by_domain, o25_store_mentioned, o26_is_allowed_url, o27_is_product_url, o28_priority, o29_is_listing_url, o30_product_pattern, o31_slug_name, o32_hosts, o33_store_label, o34_url_item, o08_seeds, o53_delays)}
ORACLES = {
    "o21_normalize_url": f"WITH {_U}, w AS (SELECT url FROM u WHERE url LIKE '%://%'), {normalize_sql('w')} SELECT * FROM nn",
    "o22_hash_url": "SELECT page_id, sha256(url) AS url_hash FROM pages",
    "o23_extract_domain": f"WITH {_U} SELECT url, {DOMAIN_SQL} AS domain FROM (SELECT *, {HOST_SQL} AS h FROM u)",
    "o24_store_by_domain": f"WITH {_D} SELECT k, domain, {by_store(lambda s: repr_sql(s.key), 'NULL')} AS store FROM d",
    "o25_store_mentioned": f"WITH {_C} SELECT k, CASE " + " ".join(f"WHEN contains(lower(url), {repr_sql(s.domain)}) THEN {repr_sql(s.key)}" for s in ST.STORES) + " END AS store FROM c",
    "o26_is_allowed_url": f"WITH {_D} SELECT k, {ALLOWED_SQL} AS allowed FROM d",
    "o27_is_product_url": f"WITH {_D} SELECT k, {by_store(lambda s: _match(s.product_patterns), 'false')} AS product FROM d",
    "o28_priority": f"WITH {_D} SELECT k, {PRIORITY_SQL} AS priority FROM d",
    "o29_is_listing_url": f"WITH {_U} SELECT url, regexp_matches(url, {repr_sql('(?i)' + U.LISTING_RE)}) AS listing FROM u",
    "o30_product_pattern": f"WITH {_D} SELECT k, regexp_matches(url, {repr_sql('(?i)' + U.PRODUCT_RE)}) OR {by_store(lambda s: _match(s.product_patterns), 'false')} AS product FROM d",
    "o32_hosts": f"WITH {_U} SELECT url, {_NET} AS netloc, replace(replace({_NET}, 'www.', ''), 'lista.', '') AS price_host FROM u",
    "o33_store_label": f"WITH {_D} SELECT k, replace(replace(domain, '.com.br', ''), 'www.', '') AS label FROM d",
    "o34_url_item": f"""WITH {_C}, w AS (SELECT k, url, depth FROM c WHERE url LIKE '%://%'), {normalize_sql('w')},
j AS (SELECT w.k, normalized AS url, w.depth FROM w JOIN nn ON nn.url = w.url), d AS (SELECT *, {DOMAIN_SQL} AS domain FROM (SELECT *, {HOST_SQL} AS h FROM j))
SELECT k, url, sha256(url) AS url_hash, domain, depth, {PRIORITY_SQL} AS priority FROM d""",
    "o08_seeds": "SELECT * FROM (VALUES " + ", ".join(f"({repr_sql(s.key)}, {len(s.seed_urls)}, 90)" for s in ST.STORES if s.enabled) + ") AS x(key, seeds, priority)",
    "o53_delays": f"WITH {_D} SELECT k, {by_store(lambda s: str(s.request_delay) + '::DOUBLE', '0.2::DOUBLE')} AS delay FROM d",
}
