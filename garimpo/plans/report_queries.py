"""Reports, browsing, joins and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions.price import display
from garimpo.functions.wordlists import REPORT_HARDWARE, REPORT_NON_HARDWARE
from garimpo.operators import report as R
from garimpo.plans.page_queries import NAMES
from garimpo.plans.views import PAGES_SQL, PRODUCTS_SQL, pages, products, repr_sql, sql_list, t
from garimpo.sources import store as S


def o52a_products_with_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_pages(products(spark, sf_dir), pages(spark, sf_dir)).select("id", "page_id", "name", "url", "domain")


def o52b_products_left_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_pages(products(spark, sf_dir), pages(spark, sf_dir), "left").select("id", "page_id", "url")


def o52f_pages_without_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).join(products(spark, sf_dir).where("price > 5000").select(F.col("page_id").alias("id")), "id", "left_anti").select("id", "url")


def o54a_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.totals(pages(spark, sf_dir), products(spark, sf_dir))


def o54b_pages_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts(pages(spark, sf_dir), "domain")


def o54c_one_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where("domain = 'example.com'").agg(F.count(F.lit(1)).alias("n"))


def o54f_domain_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.domain_shares(pages(spark, sf_dir))


def o54g_top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_categories(products(spark, sf_dir), 5)


def o54h_price_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.price_buckets(products(spark, sf_dir).withColumn("price", F.col("price") * (F.col("id") % 13) / 10)).withColumn("least", F.round("least", 2))


def o54i_products_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.products_by_domain(products(spark, sf_dir), pages(spark, sf_dir))


def o59a_dearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dearest(products(spark, sf_dir), pages(spark, sf_dir), 10)


def o59b_sample_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample_urls(pages(spark, sf_dir))


def o59c_page_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page_of(pages(spark, sf_dir), 3, 20).select("id", "url")


def o05_pages_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page_of(pages(spark, sf_dir), 2, 50, descending=False).select("id", "url")


def o61_browse_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.browse_products(products(spark, sf_dir), pages(spark, sf_dir), "Bolt", "example", 1000, 9000).select("id", "name", "price", "domain")


def o54q_browse_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o61_browse_products(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


def o62_browse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.browse_pages(pages(spark, sf_dir), "THE", "example.com").select("id", "url", "title")


def o50c_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("id") % len(NAMES) + 1).cast("int"))
    return R.class_counts(products(spark, sf_dir).withColumn("name", named))


def o69_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("id", F.substring("name", 1, 4).alias("name"), display("price").alias("price"))


def o14_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("id", S.file_name().alias("file"))


def o15_html_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = t(spark, sf_dir, "pages").where("html != ''").join(pages(spark, sf_dir).drop("url"), F.col("page_id") == F.col("id")).withColumn("depth", F.lit(0)).withColumn("content_length", F.length("html"))
    return made.select("id", F.get_json_object(S.html_index_json(), "$.file").alias("file"), F.get_json_object(S.html_index_json(), "$.content_length").cast("int").alias("content_length"))


def o16_export_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.export_products(products(spark, sf_dir).withColumn("brand", F.lit(None).cast("string")), pages(spark, sf_dir)).drop("brand")


def o17_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("id", F.to_json(F.struct("id", "name", "category"), {"ignoreNullFields": "false"}).alias("json"))


def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of inner joins from a large table to small dimensions, aggregated before the last joins need the rows."""
    line = t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n"))
    joined = line.join(t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.sum("n").alias("n"))


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(name), {repr_sql(w)})" for w in words) + ")"


_W = f"WITH {PAGES_SQL}, {PRODUCTS_SQL}"
_JOIN = "pr JOIN pg ON pr.page_id = pg.id"
QUERIES = {f.__name__: f for f in (o52a_products_with_pages, o52b_products_left_pages, o52f_pages_without_products, o54a_totals, o54b_pages_by_domain, o54c_one_domain, o54f_domain_shares, o54g_top_categories, o54h_price_buckets, o54i_products_by_domain, o59a_dearest, o59b_sample_urls, o59c_page_of, o05_pages_batch, o61_browse_products, o54q_browse_count, o62_browse_pages, o50c_class_report, o69_display, o14_file_names, o15_html_index, o16_export_products, o17_json_lines, star_revenue)}
_BROWSE = f"{_JOIN} WHERE lower(name) LIKE '%bolt%' AND domain LIKE '%example%' AND price >= 1000 AND price <= 9000"
ORACLES = {
    "o52a_products_with_pages": f"{_W} SELECT pr.id, page_id, name, url, domain FROM {_JOIN}",
    "o52b_products_left_pages": f"{_W} SELECT pr.id, page_id, url FROM pr LEFT JOIN pg ON pr.page_id = pg.id",
    "o52f_pages_without_products": f"{_W} SELECT id, url FROM pg WHERE id NOT IN (SELECT page_id FROM pr WHERE price > 5000)",
    "o54a_totals": f"{_W} SELECT (SELECT count(*) FROM pg) AS total_pages, (SELECT count(*) FROM pg WHERE is_product_page) AS product_pages, count(*) AS total_products, count(*) FILTER (price > 0) AS priced, round(count(*) FILTER (price > 0) * 100.0 / count(*), 1) AS price_rate FROM pr",
    "o54b_pages_by_domain": f"{_W} SELECT domain, count(*) AS n FROM pg GROUP BY 1",
    "o54c_one_domain": f"{_W} SELECT count(*) AS n FROM pg WHERE domain = 'example.com'",
    "o54f_domain_shares": f"{_W} SELECT domain, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM pg GROUP BY 1",
    "o54g_top_categories": f"{_W} SELECT coalesce(category, 'sem categoria') AS category, count(*) AS n FROM pr GROUP BY 1 ORDER BY n DESC, category LIMIT 5",
    "o54h_price_buckets": f"{_W}, q AS (SELECT price * (id % 13) / 10 AS price FROM pr) SELECT CASE " + " ".join(f"WHEN price < {m} THEN {repr_sql(n)}" for m, n in R.BUCKETS) + f" ELSE {repr_sql(R.OTHER_BUCKET)} END AS bucket, count(*) AS n, round(min(price), 2) AS least FROM q WHERE price > 0 GROUP BY 1",
    "o54i_products_by_domain": f"{_W} SELECT domain, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM {_JOIN} GROUP BY 1",
    "o59a_dearest": f"{_W} SELECT pr.id, substr(name, 1, 55) AS name, price, store, domain, 'R$ ' || format('{{:,.2f}}', price) AS shown FROM {_JOIN} WHERE price IS NOT NULL ORDER BY price DESC, pr.id LIMIT 10",
    "o59b_sample_urls": f"{_W}, d AS (SELECT domain FROM pg GROUP BY 1 ORDER BY count(*) DESC, domain LIMIT 3), r AS (SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY id)::INT AS k, id, url FROM pg WHERE domain IN (SELECT domain FROM d)) SELECT * FROM r WHERE k <= 3",
    "o59c_page_of": f"{_W} SELECT id, url FROM pg ORDER BY id DESC LIMIT 20 OFFSET 40",
    "o05_pages_batch": f"{_W} SELECT id, url FROM pg ORDER BY id LIMIT 50 OFFSET 50",
    "o61_browse_products": f"{_W} SELECT pr.id, name, price, domain FROM {_BROWSE}",
    "o54q_browse_count": f"{_W} SELECT count(*) AS n FROM {_BROWSE}",
    "o62_browse_pages": f"{_W} SELECT id, url, title FROM pg WHERE (lower(title) LIKE '%the%' OR lower(url) LIKE '%the%') AND domain LIKE '%example.com%'",
    "o50c_class_report": f"{_W}, q AS (SELECT list_extract([{sql_list(NAMES)}], id % {len(NAMES)} + 1) AS name FROM pr), c AS (SELECT CASE WHEN coalesce(name, '') = '' THEN 'unknown' WHEN {_any(REPORT_HARDWARE)} THEN 'hardware' WHEN {_any(REPORT_NON_HARDWARE)} THEN 'non_hardware' ELSE 'unknown' END AS class FROM q) SELECT class, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM c GROUP BY 1",
    "o69_display": f"{_W} SELECT id, substr(name, 1, 4) AS name, CASE WHEN price IS NULL OR price = 0 THEN '-' ELSE 'R$ ' || format('{{:,.2f}}', price) END AS price FROM pr",
    "o14_file_names": f"{_W} SELECT id, domain || '/' || lpad(id::VARCHAR, 6, '0') || '.html' AS file FROM pg",
    "o15_html_index": f"{_W} SELECT pg.id, domain || '/' || lpad(pg.id::VARCHAR, 6, '0') || '.html' AS file, length(html)::INT AS content_length FROM pg JOIN pages ON page_id = pg.id WHERE html <> ''",
    "o16_export_products": f"{_W} SELECT pr.id, name, CASE WHEN price <> 0 THEN price END AS price, store, category, coalesce(url, '') AS url FROM pr LEFT JOIN pg ON pr.page_id = pg.id",
    "o17_json_lines": f"{_W} SELECT id, '{{\"id\":' || id || ',\"name\":\"' || name || '\",\"category\":' || coalesce('\"' || category || '\"', 'null') || '}}' AS json FROM pr",
    "star_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
}
