"""The relational tables on Parquet: appending pages, products, links and frontier rows, exports, removal."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.functions import url as U
from garimpo.functions.html import ANCHOR, NAME
from garimpo.schemas import TABLES, schema

PAGE_SIZE = 500


class Store:
    """Tables under one folder; a table that has no files is an empty one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(schema(name)).parquet(f"{self.path}/{name}") if self._there(name) else self.spark.createDataFrame([], schema(name))

    def append(self, name: str, rows: DataFrame, order: list[str]) -> DataFrame:
        """Append rows with ids that go on from the largest; columns that rows lack are NULL."""
        last = self.table(name).agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
        known = set(rows.columns)
        numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.col("_n"))
        kinds = [x.split()[:2] for x in schema(name).replace(" not null", "").split(", ")]
        out = numbered.select(*[F.col(c).cast(k).alias(c) if c == "id" or c in known else F.lit(None).cast(k).alias(c) for c, k in kinds])
        out.write.mode("append").parquet(f"{self.path}/{name}")
        return out

    def save_pages(self, pages: DataFrame) -> None:
        """pages(url, status_code, title, html_content, text_content, depth, ...): each new url_hash once, with lengths in characters."""
        made = pages.withColumn("url_hash", U.hash_url("url")).withColumn("domain", U.domain("url")).withColumn("content_length", F.length("html_content"))
        first = made.dropDuplicates(["url_hash"]).join(self.table("pages").select("url_hash"), "url_hash", "left_anti")
        self.append("pages", first.withColumn("crawled_at", F.localtimestamp()), ["url"])

    def save_products(self, products: DataFrame) -> None:
        """products(page_id, name, store, price, ...), one for each page; a price makes the first row of its history."""
        new = products.dropDuplicates(["page_id"]).join(self.table("products").select("page_id"), "page_id", "left_anti")
        now = F.localtimestamp()
        new = new.withColumn("name", F.substring("name", 1, NAME)).withColumn("currency", F.lit("BRL")).withColumn("first_seen", now).withColumn("last_updated", now)
        before = self.table("products").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        self.append("products", new, ["page_id"])
        added = self.table("products").where(F.col("id") > before)
        self.append("price_history", added.where("price is not null and price != 0").select(F.col("id").alias("product_id"), "price", F.col("first_seen").alias("recorded_at")), ["product_id"])

    def _read(self, name: str, kinds: str) -> DataFrame:
        return self.spark.read.schema(kinds).parquet(f"{self.path}/{name}") if self._there(name) else self.spark.createDataFrame([], kinds)

    def robots_of(self, hosts: DataFrame, get: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """host and text of robots.txt for hosts(host, scheme); each host is asked once and for good."""
        known = self._read("robots", "host string, text string")
        new = hosts.dropDuplicates(["host"]).join(known, "host", "left_anti")
        if new.limit(1).count():
            get(new).select("host", "text").write.mode("append").parquet(f"{self.path}/robots")
            known = self._read("robots", "host string, text string")
        return known.join(hosts.select("host"), "host", "left_semi").groupBy("host").agg(F.max("text").alias("text"))

    def last_asked(self) -> DataFrame:
        """host and last_at, seconds since 1970."""
        return self._read("hosts", "host string, last_at double").groupBy("host").agg(F.max("last_at").alias("last_at"))

    def note_asked(self, hosts: DataFrame) -> None:
        hosts.select("host", F.unix_micros(F.current_timestamp()).cast("double").alias("at")).select("host", (F.col("at") / 1e6).alias("last_at")).write.mode("append").parquet(f"{self.path}/hosts")

    def keep_fetched(self, results: DataFrame) -> DataFrame:
        """What was fetched, written and read again."""
        path = f"{self.path}/fetched/{uuid.uuid4().hex}"
        results.write.parquet(path)
        return self.spark.read.parquet(path)

    def save_links(self, links: DataFrame) -> None:
        """links(source_page_id, pos, url, anchor_text) of pages whose links aren't there yet."""
        links = links.join(self.table("links").select("source_page_id").distinct(), "source_page_id", "left_anti")
        made = links.select("source_page_id", "pos", F.col("url").alias("target_url"), U.hash_url("url").alias("target_url_hash"), F.substring("anchor_text", 1, ANCHOR).alias("anchor_text"), F.localtimestamp().alias("discovered_at"))
        self.append("links", made, ["source_page_id", "pos"])

    def add_to_frontier(self, admitted: DataFrame) -> int:
        """Rows of admitted(seq, url, url_hash, domain, priority, depth) that aren't there yet; how many were."""
        new = admitted.dropDuplicates(["url_hash"]).join(self.table("frontier").select("url_hash"), "url_hash", "left_anti")
        rows = new.withColumn("status", F.lit("pending")).withColumn("retries", F.lit(0)).withColumn("added_at", F.localtimestamp())
        before = self.table("frontier").count()
        self.append("frontier", rows, ["seq"])
        return self.table("frontier").count() - before

    def pages_batch(self, offset: int = 0, limit: int = PAGE_SIZE) -> DataFrame:
        return self.table("pages").orderBy("id").offset(offset).limit(limit)

    def clean(self, names: list[str] | None = None) -> list[str]:
        """Remove tables; the names of those that were there."""
        gone = []
        for name in names or TABLES:
            if name not in TABLES:
                raise ValueError(f"no table {name}")
            if self._there(name):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
                gone.append(name)
        return gone


def file_name(domain: str = "domain", page_id: str = "id"):
    """Where a page's HTML goes: ``domain/000042.html``."""
    return F.format_string("%s/%06d.html", F.col(domain), F.col(page_id))


def write_files(files: DataFrame, path: str) -> int:
    """A file of each row of files(file, content) under ``path``, written where the row is; how many there are.

    A task that is tried again writes the same files. ``path`` is a folder that all executors reach: a file system that
    pyarrow knows, or a shared local one.
    """
    base = path if "://" in path else os.path.abspath(path.removeprefix("file:"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(base)
        made: set[str] = set()
        for frame in frames:
            for r in frame.itertuples(index=False):
                folder = f"{root}/{r.file}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{root}/{r.file}") as f:
                    f.write(r.content.encode("utf-8", "replace"))
            yield pd.DataFrame({"file": frame["file"]})

    return files.select("file", "content").mapInPandas(run, "file string").count()


def export_html(pages: DataFrame, path: str, limit: int | None = None) -> int:
    """Each page's HTML in a file of its own, ``domain/000042.html``, and an index of JSON lines that names them; how many.

    Pages without HTML are left out before the limit counts.
    """
    some = pages.where("html_content is not null and html_content != ''")
    some = some.orderBy("id").limit(limit) if limit else some
    n = write_files(some.select(file_name().alias("file"), F.col("html_content").alias("content")), path)
    some.select(html_index_json().alias("value")).write.mode("overwrite").text(f"{path}/index.jsonl")
    return n


def html_index_json():
    return F.to_json(F.struct("id", "url", "domain", "title", "depth", "is_product_page", "content_length", file_name().alias("file")), {"ignoreNullFields": "false"})


def export_pages(pages: DataFrame) -> DataFrame:
    return pages.select("id", "url", "domain", "title", "is_product_page", F.col("crawled_at").cast("string").alias("crawled_at"))


def export_products(products: DataFrame, pages: DataFrame) -> DataFrame:
    """With the page's URL, '' where the page is missing; a price of 0 counts as none."""
    joined = products.join(pages.select(F.col("id").alias("page_id"), "url"), "page_id", "left")
    return joined.select("id", "name", F.when(F.col("price") != 0, F.col("price")).alias("price"), "store", "category", "brand", F.coalesce("url", F.lit("")).alias("url"))


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, array: bool = False) -> None:
    """JSON lines with NULL fields kept; or one array in one file, for tables that one task can write."""
    if array:
        fields = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        numbered = df.select(fields.alias("row"), F.monotonically_increasing_id().alias("n")).coalesce(1).sortWithinPartitions("n")
        first = F.lag("row").over(Window.orderBy("n")).isNull()
        last = F.lead("row").over(Window.orderBy("n")).isNull()
        lines = numbered.select("n", F.concat(F.when(first, "[\n").otherwise(""), F.col("row"), F.when(last, "\n]").otherwise(",")).alias("value"))
        (lines.select("value") if df.limit(1).count() else df.sparkSession.range(1).select(F.lit("[]").alias("value"))).coalesce(1).write.mode("overwrite").text(path)
        return
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
