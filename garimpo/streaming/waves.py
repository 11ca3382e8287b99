"""Crawling as waves, and the streams around it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions import html as H
from garimpo.functions import url as U
from garimpo.operators import frontier as FR
from garimpo.operators.products import products as product_rows
from garimpo.sources.store import Store
from garimpo.sources.web import accepted, robots_udf


def wave(store: Store, fetch: Callable[[DataFrame], DataFrame], size: int, stores=None, robots: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """One wave: schedule, skip pages that are there or that robots.txt bars, fetch, store pages, products and links, admit new URLs, set statuses. URLs tried.

    ``fetch`` gets url, host, the shop's delay, and when the host was last asked. What it brought is written before
    anything is made of it, and every table takes only what it lacks, so that no page is asked for twice.
    """
    pending = store.table("frontier").join(_done(store), "url_hash", "left_anti")
    batch = FR.scheduled(pending.withColumn("seq", F.col("id")), size).join(store.table("pages").select("url_hash"), "url_hash", "left_anti")
    rows = batch.collect()  # ``size`` rows at most
    if not rows:
        return 0
    batch = store.spark.createDataFrame(rows, batch.schema).withColumn("host", U.netloc("url"))
    asked = batch
    if robots is not None:
        path = F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^#]*)", 1)
        rules = store.robots_of(batch.select("host", U.scheme("url").alias("scheme")).distinct(), robots)
        asked = batch.join(F.broadcast(rules), "host", "left").where(robots_udf()("text", path)).drop("text")
    urls = asked.join(F.broadcast(store.last_asked()), "host", "left").select("url", "host", FR.delay_of("url", stores).alias("delay"), "last_at")
    results = store.keep_fetched(fetch(urls))
    store.note_asked(urls.select("host").distinct())
    fine = accepted(results).join(batch.select("url", "depth"), "url")
    read = fine.withColumn("page", H.page_udf()("html", "url"))
    store.save_pages(read.select("url", "status_code", F.col("page.title").alias("title"), F.col("html").alias("html_content"), F.col("page.text").alias("text_content"), "depth", "crawl_time_ms", U.is_product_url("url", stores).alias("is_product_page")))
    saved = store.table("pages").join(batch.select("url_hash"), "url_hash", "left_semi")
    store.save_products(product_rows(saved.where("is_product_page").select(F.col("id").alias("page_id"), "url", F.col("html_content").alias("html"), "domain")))
    links = saved.select(F.col("id").alias("source_page_id"), "depth", F.posexplode(H.links("url", "html_content", stores)).alias("pos", "link")).select("source_page_id", "depth", "pos", "link.*")
    store.save_links(links)
    known = store.table("frontier").select("url_hash").union(store.table("pages").select("url_hash"))
    store.add_to_frontier(FR.admit(links.select("url", (F.col("depth") + 1).alias("depth"), (F.col("source_page_id") * 10_000 + F.col("pos")).alias("seq")), known, stores=stores))
    status = batch.select("url", "url_hash").join(results.select("url", F.when(F.expr("error is null and status_code = 200"), "done").otherwise("failed").alias("status")), "url", "left")
    status.select("url_hash", F.coalesce("status", F.lit("failed")).alias("status"), F.localtimestamp().alias("at")).write.mode("append").parquet(f"{store.path}/frontier_status")
    return len(rows)


def _done(store: Store) -> DataFrame:
    """URLs that are done or failed; what was only begun when a run ended is still pending."""
    if not store._there("frontier_status"):
        return store.spark.createDataFrame([], "url_hash string")
    return store.spark.read.parquet(f"{store.path}/frontier_status").select("url_hash").distinct()


def crawl(store: Store, fetch: Callable[[DataFrame], DataFrame], max_pages: int, size: int = 25, stores=None, progress: Callable[[int], None] | None = None, robots: Callable[[DataFrame], DataFrame] | None = None, stop: Callable[[], bool] = lambda: False) -> int:
    """Waves until ``max_pages`` URLs are tried, nothing is pending, or ``stop`` says so between waves; begun again, it goes on."""
    total = 0
    while total < max_pages and not stop():
        n = wave(store, fetch, min(size, max_pages - total), stores, robots)
        if not n:
            break
        total += n
        if progress:
            progress(total)
    return total


def fresh_urls(stream: DataFrame, horizon: str | None = None, at: str = "at") -> DataFrame:
    """First sight of each url_hash: for ever, or within a watermark of ``horizon``, which bounds the state."""
    if horizon is None:
        return stream.dropDuplicates(["url_hash"])
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["url_hash"])


def rates(stream: DataFrame, window: str = "1 minute", late: str = "10 minutes", at: str = "at") -> DataFrame:
    """Requests and failures by domain and window."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, window), "domain").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "failed").alias("failed"))
    return counted.select(F.col("window.start").alias("minute"), "domain", "pages", "failed")


def paced(stream: DataFrame, delay: float) -> DataFrame:
    """When each request of stream(host, seq, at seconds) may go, with each host's last time as state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        out = []
        for r in rows.itertuples(index=False):
            last = r.at if last is None else max(r.at, last + delay)
            out.append((key[0], r.seq, r.at, last))
        state.update((float(last),))
        yield pd.DataFrame(out, columns=["host", "seq", "at", "go_at"])

    return stream.groupBy("host").applyInPandasWithState(run, "host string, seq long, at double, go_at double", "last double", "append", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to Parquet; begun again with its checkpoint it goes on where it ended."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def to_versions(stream: DataFrame, path: str, checkpoint: str):
    """Write what each batch of an aggregated stream changed to a folder of its own; a batch that is run again replaces its folder."""
    q = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{path}/batch={k}")).start()
    q.awaitTermination()
    return q


def newest(versions: DataFrame, *keys: str) -> DataFrame:
    """The last version of each key's row."""
    rest = [c for c in versions.columns if c not in (*keys, "batch")]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch").cast("long")).alias("last")).select(*keys, "last.*")
