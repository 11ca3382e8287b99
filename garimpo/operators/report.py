"""Reports and browsing over pages(id, url, domain, title, is_product_page, text_content) and products(id, page_id, name, price, category, store)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import classify
from garimpo.functions.price import display

BUCKETS = [(100, "up to 100"), (500, "100 to 500"), (1000, "500 to 1000"), (5000, "1000 to 5000")]
OTHER_BUCKET, NO_CATEGORY = "over 5000", "sem categoria"


def share(part: Column, whole: Column, places: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * 100 / whole, places)).otherwise(F.lit(0.0))


def totals(pages: DataFrame, products: DataFrame) -> DataFrame:
    """One row: pages, product pages, products, priced products and their percentage."""
    a = pages.agg(F.count(F.lit(1)).alias("total_pages"), F.count_if("is_product_page").alias("product_pages"))
    b = products.agg(F.count(F.lit(1)).alias("total_products"), F.count_if(F.col("price") > 0).alias("priced"))
    return a.crossJoin(b).withColumn("price_rate", share(F.col("priced"), F.col("total_products")))  # one row each


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def domain_shares(pages: DataFrame) -> DataFrame:
    """Pages by domain with their percentage of all, most first; the window runs over domains, not pages."""
    return counts(pages, "domain").withColumn("pct", share(F.col("n"), F.sum("n").over(Window.partitionBy()))).orderBy(F.col("n").desc(), "domain")


def top_categories(products: DataFrame, n: int = 10) -> DataFrame:
    return products.groupBy(F.coalesce("category", F.lit(NO_CATEGORY)).alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "category").limit(n)


def price_buckets(products: DataFrame) -> DataFrame:
    bucket = F.lit(OTHER_BUCKET)
    for most, name in BUCKETS[::-1]:
        bucket = F.when(F.col("price") < most, name).otherwise(bucket)
    return products.where("price > 0").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("least")).orderBy("least")


def with_pages(products: DataFrame, pages: DataFrame, how: str = "inner") -> DataFrame:
    return products.join(pages.select(F.col("id").alias("page_id"), "url", "domain"), "page_id", how)


def products_by_domain(products: DataFrame, pages: DataFrame) -> DataFrame:
    return domain_shares(with_pages(products, pages))


def dearest(products: DataFrame, pages: DataFrame, n: int = 10) -> DataFrame:
    """The n dearest are cut before the join with pages, so that it carries n rows; products without a page are left out first."""
    there = products.where("price is not null").join(pages.select(F.col("id").alias("page_id")), "page_id", "left_semi")
    top = there.orderBy(F.col("price").desc(), "id").limit(n)
    return top.join(pages.select(F.col("id").alias("page_id"), "domain"), "page_id").select("id", F.substring("name", 1, 55).alias("name"), "price", "store", "domain", display("price").alias("shown"))


def sample_urls(pages: DataFrame, domains: int = 3, each: int = 3) -> DataFrame:
    """The first URLs by id of each of the largest domains."""
    top = counts(pages, "domain").orderBy(F.col("n").desc(), "domain").limit(domains)
    w = Window.partitionBy("domain").orderBy("id")
    return pages.join(F.broadcast(top.select("domain")), "domain").withColumn("k", F.row_number().over(w)).where(F.col("k") <= each).select("domain", "k", "id", "url")


def browse_products(products: DataFrame, pages: DataFrame, name: str | None = None, domain: str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """Products with their pages by optional conditions; name and domain are LIKE patterns within the text, name without case."""
    found = with_pages(products, pages)
    if name:
        found = found.where(F.lower("name").like(f"%{name.lower()}%"))
    if domain:
        found = found.where(F.col("domain").like(f"%{domain}%"))
    if least is not None:
        found = found.where(F.col("price") >= least)
    if most is not None:
        found = found.where(F.col("price") <= most)
    return found


def browse_pages(pages: DataFrame, search: str | None = None, domain: str | None = None) -> DataFrame:
    found = pages
    if search:
        found = found.where(F.lower("title").like(f"%{search.lower()}%") | F.lower("url").like(f"%{search.lower()}%"))
    return found.where(F.col("domain").like(f"%{domain}%")) if domain else found


def page_of(df: DataFrame, number: int, size: int, by: str = "id", descending: bool = True) -> DataFrame:
    """The ``number``-th page from 1 of the rows by ``by``."""
    return df.orderBy(F.col(by).desc() if descending else F.col(by)).offset((number - 1) * size).limit(size)


def class_counts(products: DataFrame) -> DataFrame:
    """The product report's classes, with counts and percentages."""
    return products.groupBy(classify.report_class("name").alias("class")).agg(F.count(F.lit(1)).alias("n")).withColumn("pct", share(F.col("n"), F.sum("n").over(Window.partitionBy())))


def non_hardware_samples(products: DataFrame, n: int = 20) -> DataFrame:
    return products.where(classify.report_class("name") == "non_hardware").orderBy("id").limit(n).select("id", F.substring("name", 1, 70).alias("name"))


def price_changes(history: DataFrame) -> DataFrame:
    """Each product's prices in time with the one before and the change."""
    w = Window.partitionBy("product_id").orderBy("recorded_at", "id")
    return history.withColumn("before", F.lag("price").over(w)).withColumn("change", F.round(F.col("price") - F.col("before"), 2))


