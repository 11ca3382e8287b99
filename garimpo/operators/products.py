"""From product pages to product rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions import classify
from garimpo.functions import html as H
from garimpo.functions import url as U
from garimpo.functions.price import text_price


def products(pages: DataFrame, strict_listing: bool = False) -> DataFrame:
    """page_id, name, sku, brand, price, price_raw, category, store of pages(page_id, url, html, domain) that show hardware.

    The name is that of the page's data, else its title, else its address; an address is replaced by the name in it.
    Pages go that still have none, that have a general title, that aren't hardware, or that are blocked and have no
    price. ``strict_listing`` leaves out listings too.
    """
    use = pages.where(~U.is_listing_url("url")) if strict_listing else pages
    read = use.withColumn("page", H.page_udf()("html", "url"))
    named = read.withColumn("name", F.coalesce(F.when(F.col("page.name") != "", F.col("page.name")), F.col("page.title"), F.col("url")))
    slug = U.slug_name("name")
    named = named.withColumn("name", F.when(F.col("name").rlike("^https?://") & (slug != ""), slug).otherwise(F.col("name")))
    kept = named.where(~F.col("name").startswith("http") & ~classify.is_generic("name") & (classify.hardware_class("name") == "hardware"))
    found = text_price("html")
    priced = kept.withColumn("shown", found).withColumn("price", F.coalesce("page.price", "shown.price")).withColumn("price_raw", F.when(F.col("page.price").isNotNull(), F.col("page.price_raw")).otherwise(F.col("shown.raw")))
    priced = priced.where(~classify.is_blocked("html") | F.col("price").isNotNull())
    return priced.select("page_id", F.substring("name", 1, H.NAME).alias("name"), F.col("page.sku").alias("sku"), F.col("page.brand").alias("brand"), "price", "price_raw", classify.category("name").alias("category"), U.store_label("domain").alias("store"))
