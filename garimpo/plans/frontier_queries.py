"""Scheduling, politeness, status and streams over events as a crawl's log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import url as U
from garimpo.functions.stores import Store
from garimpo.operators import frontier as FR
from garimpo.operators import report as R
from garimpo.plans.url_queries import normalize_sql
from garimpo.plans.views import DOMAIN_SQL, HOST_SQL, REQUESTS_SQL, repr_sql, requests, t
from garimpo.sources import scratch, web
from garimpo.streaming import waves

#: Shops for the given pages' hosts.
HOSTS = [Store("com", "Com", "example.com", [r"/en/\d+"], [r"/en/9\d\d"]), Store("net", "Net", "example.net", [r"\.html"], ["spam"], enabled=True), Store("org", "Org", "example.org", ["/never/"], ["#x"], enabled=False)]
RULES = [("8", "/a", False), ("8", "/a/b", True), ("46", "/", False), ("7", "/x", False)]
DELAY = 4000.0
#: How much earlier than the newest event one may be and still count; the state holds the windows of that time.
LATE = "3650 days"


def o53_permitted_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = requests(spark, sf_dir).select("seq", "host", (F.unix_micros(F.col("at").cast("timestamp")) / 1e6).alias("at"))
    return FR.permitted_times(made, DELAY).select("seq", "host", F.round("go_at", 3).alias("go_at"))


def o54d_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.status_counts(requests(spark, sf_dir))


def o54o_crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = requests(spark, sf_dir).select("domain", (F.col("status") != "error").alias("ok"), F.col("priority").cast("long").alias("bytes"), F.col("at").cast("timestamp").alias("at"))
    return FR.crawl_counters(log)


def o54o_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("id", FR.clock(F.col("id") * 37).alias("clock"))


def o54p_politeness_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.politeness_stats(requests(spark, sf_dir).select("host", (F.col("id") % 3 * 0.1).alias("delay"), (F.col("id") % 50 == 0).alias("robots_fetched")))


def o55_scheduled_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.scheduled(requests(spark, sf_dir).where("status = 'view'").withColumn("domain", F.when(F.col("id") % 3 == 0, F.col("domain")).otherwise("big")), 300).select("seq", "domain", "priority")


def o56_dequeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).withColumn("status", F.when(F.col("status") == "view", "pending").otherwise("done")).withColumn("added_at", F.col("at"))
    return FR.dequeue(rows, 50).select("id", "priority")


def o60_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"error": "failed", "purchase": "done", "signup": "done"}
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col("status")), F.lit("pending"))
    return FR.latest_status(requests(spark, sf_dir).withColumn("status", status)).select("url_hash", "status", "retries")


def o64_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = t(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url", (F.col("page_id") % 25).cast("int").alias("depth"))
    seen = t(spark, sf_dir, "pages").where("page_id % 10 = 0").select(U.hash_url(U.normalize("url")).alias("url_hash"))
    return FR.admit(urls, seen, stores=HOSTS).select("seq", "url", "domain", "depth", "priority")


def o65_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir)
    return FR.unseen(rows.where("status = 'view'"), rows.where("status = 'error'")).select("seq", "url_hash")


def o52h_robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).select("seq", "host", F.concat(F.lit("/"), F.element_at(F.array(*[F.lit(x) for x in ("a/x", "a/b/c", "x/1", "y")]), (F.col("id") % 4 + 1).cast("int"))).alias("path"))
    return FR.robots_allowed(rows, spark.createDataFrame(RULES, "host string, prefix string, allow boolean")).select("seq", "allowed")


def o02_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(8).select(F.col("id").alias("attempt"), web.backoff(F.col("id")).alias("seconds"))


def o66_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).select("id", F.when(F.col("status") == "error", "Timeout").alias("error"), F.when(F.col("id") % 4 == 0, 404).otherwise(200).alias("status_code"))
    return web.accepted(rows).select("id")


def o67_html_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["text/html; charset=utf-8", "application/pdf", "Application/XHTML+xml", "", None]
    return spark.createDataFrame(list(enumerate(kinds)), "k int, kind string").select("k", web.html_type("kind").alias("html"))


def o10_price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price history (the working form of the unused one): each product's change from the price before."""
    history = requests(spark, sf_dir).where("status = 'purchase'").select("id", F.col("host").alias("product_id"), F.col("value").alias("price"), F.col("at").alias("recorded_at"))
    return R.price_changes(history).select("id", "product_id", "price", "change")


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = t(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    return stream.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("host"), F.col("user_id").cast("string").alias("domain"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"), F.sha2(F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 40).cast("string")), 256).alias("url_hash"))


def _places(spark: SparkSession, kind: str) -> tuple[str, str]:
    """Folders of a stream's rows and of its checkpoint, both shared."""
    at = f"{scratch.folder(spark)}/stream-{kind}-{uuid.uuid4().hex}"
    return f"{at}/rows", f"{at}/checkpoint"


def o75_stream_fresh_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, checkpoint = _places(spark, "fresh")
    waves.to_table(waves.fresh_urls(_events_stream(spark, sf_dir).select("url_hash", "host")), rows, checkpoint)
    return spark.read.schema("url_hash string, host string").parquet(rows)


def o54o_stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files come in any order of time: nothing within LATE of the newest event is too late to be counted."""
    rows, checkpoint = _places(spark, "rates")
    waves.to_versions(waves.rates(_events_stream(spark, sf_dir), "1 hour", LATE), rows, checkpoint)
    versions = spark.read.schema("minute timestamp, domain string, pages long, failed long, batch long").parquet(rows)
    return waves.newest(versions, "minute", "domain").groupBy("minute").agg(F.sum("pages").alias("pages"), F.sum("failed").alias("failed"))


def o53_stream_paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, checkpoint = _places(spark, "paced")
    waves.to_table(waves.paced(_events_stream(spark, sf_dir).select("host", "seq", F.col("at").cast("double").alias("at")), DELAY), rows, checkpoint)
    return spark.read.schema("host string, seq long, at double, go_at double").parquet(rows).select("seq", "host", F.round("go_at", 3).alias("go_at"))


def o73_crawl_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of a made-up site of the first shop, offline: what it stored of each page."""
    from garimpo.sources.store import Store as Tables

    site = {"https://www.kabum.com.br/hardware": '<title>Hardware</title><a href="/produto/1/ssd-nvme">SSD</a><a href="/produto/2/livro">b</a><a href="/carrinho">c</a>', "https://www.kabum.com.br/produto/1/ssd-nvme": '<title>SSD NVMe 1TB</title><h1>SSD NVMe 1TB</h1><b>R$ 499,90</b><a href="/hardware">h</a>', "https://www.kabum.com.br/produto/2/livro": "<title>Livro</title><h1>Livro de receitas</h1>"}
    pages = spark.createDataFrame(list(site.items()), "url string, html string")

    def fetch(urls: DataFrame) -> DataFrame:
        found = urls.join(pages, "url", "left")
        return found.select("url", F.when(F.col("html").isNotNull(), 200).otherwise(404).alias("status_code"), F.lit("text/html").alias("content_type"), "html", F.length("html").alias("content_length"), F.lit(1).alias("crawl_time_ms"), F.lit(None).cast("string").alias("error"))

    store = Tables(spark, f"{scratch.folder(spark)}/crawl-{uuid.uuid4().hex}")
    seeds = spark.createDataFrame([(0, "https://www.kabum.com.br/hardware", 0)], "seq long, url string, depth int")
    store.add_to_frontier(FR.admit(seeds, store.table("pages")))
    waves.crawl(store, fetch, 10, 5)
    shown = store.table("pages").join(store.table("products").select(F.col("page_id").alias("id"), "name", "price"), "id", "left")
    return shown.select("url", "title", "depth", "is_product_page", "name", "price")


_R = f"WITH {REQUESTS_SQL}"
_PACED = f"""{_R}, s AS (SELECT seq, host, epoch_us(ats) / 1e6 AS arrival, row_number() OVER (PARTITION BY host ORDER BY ats, seq) AS i FROM rq)
SELECT seq, host, round(max(arrival - i * {DELAY}) OVER (PARTITION BY host ORDER BY i) + i * {DELAY}, 3) AS go_at FROM s"""


def _by(pick, other: str) -> str:
    return "CASE domain " + " ".join(f"WHEN {repr_sql(s.domain)} THEN {pick(s)}" for s in HOSTS) + f" ELSE {other} END"


_FINE = _by(lambda s: f"{str(s.enabled).lower()} AND NOT regexp_matches(url, {repr_sql('(?i)' + '|'.join(s.ignore_patterns))})", "false") + f" AND NOT regexp_matches(lower(url), {repr_sql('[.](' + '|'.join(U.FILE_ENDINGS) + ')$')})"
_PRIORITY = _by(lambda s: f"CASE WHEN regexp_matches(url, {repr_sql('(?i)' + '|'.join(s.product_patterns))}) THEN 100 WHEN regexp_matches(lower(url), {repr_sql('|'.join(U.LISTING_PARTS))}) THEN 80 ELSE greatest(10, 50 - 2 * depth) END", "0")
QUERIES = {f.__name__: f for f in (o53_permitted_times, o54d_status_counts, o54o_crawl_counters, o54o_clock, o54p_politeness_stats, o55_scheduled_batch, o56_dequeue, o60_latest_status, o64_admit, o65_unseen, o52h_robots_rules, o02_backoff, o66_accepted, o67_html_type, o10_price_changes, o75_stream_fresh_urls, o54o_stream_rates, o53_stream_paced, o73_crawl_waves)}
ORACLES = {
    "o53_permitted_times": _PACED,
    "o53_stream_paced": _PACED,
    "o54d_status_counts": f"{_R} SELECT status, count(*) AS n FROM rq GROUP BY 1",
    "o54o_crawl_counters": f"{_R} SELECT domain, count(*) FILTER (status <> 'error') AS crawled, count(*) FILTER (status = 'error') AS failed, sum(priority)::BIGINT AS bytes, round(CASE WHEN max(ats) > min(ats) THEN count(*) FILTER (status <> 'error') * 60e6 / (epoch_us(max(ats)) - epoch_us(min(ats))) END, 2) AS pages_per_minute FROM rq GROUP BY 1",
    "o54o_clock": f"{_R} SELECT id, printf('%02d:%02d:%02d', (id * 37) // 3600, (id * 37) % 3600 // 60, (id * 37) % 60) AS clock FROM rq",
    "o54p_politeness_stats": f"{_R} SELECT host, count(*) AS requests, max(id % 3 * 0.1::DOUBLE) AS delay, bool_or(id % 50 = 0) AS robots_fetched FROM rq GROUP BY 1",
    "o55_scheduled_batch": f"""{_R}, p AS (SELECT seq, CASE WHEN id % 3 = 0 THEN domain ELSE 'big' END AS domain, priority FROM rq WHERE status = 'view'),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, seq) AS rd, greatest(1, 300 // (SELECT count(DISTINCT domain) FROM p)) AS cap FROM p)
SELECT seq, domain, priority FROM r ORDER BY rd > cap, priority DESC, seq LIMIT 300""",
    "o56_dequeue": f"{_R} SELECT id, priority FROM rq WHERE status = 'view' ORDER BY priority DESC, ats, id LIMIT 50",
    "o60_latest_status": f"{_R}, s AS (SELECT *, CASE status WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'done' ELSE 'pending' END AS st FROM rq) SELECT url_hash, arg_max(st, (ats, id)) AS status, count(*) FILTER (st = 'failed') AS retries FROM s GROUP BY 1",
    "o64_admit": f"""WITH {normalize_sql('pages')},
p AS (SELECT page_id AS seq, normalized AS url, (page_id % 25)::INT AS depth FROM pages JOIN nn USING (url) WHERE page_id % 25 <= 20),
d AS (SELECT *, {DOMAIN_SQL} AS domain FROM (SELECT *, {HOST_SQL} AS h FROM p)),
f AS (SELECT seq, url, domain, depth, {_PRIORITY} AS priority, row_number() OVER (PARTITION BY url ORDER BY seq) AS k FROM d WHERE {_FINE})
SELECT seq, url, domain, depth, priority FROM f WHERE k = 1 AND url NOT IN (SELECT normalized FROM pages JOIN nn USING (url) WHERE page_id % 10 = 0)""",
    "o65_unseen": f"{_R} SELECT min(seq) AS seq, url_hash FROM rq WHERE status = 'view' AND url_hash NOT IN (SELECT url_hash FROM rq WHERE status = 'error') GROUP BY url_hash",
    "o52h_robots_rules": f"{_R}, q AS (SELECT seq, host, list_extract(['/a/x', '/a/b/c', '/x/1', '/y'], id % 4 + 1) AS path FROM rq), r(host, prefix, allow) AS (VALUES {', '.join(f'({repr_sql(h)}, {repr_sql(p)}, {str(a).lower()})' for h, p, a in RULES)}), b AS (SELECT q.seq, arg_max(allow, length(prefix)) AS allow FROM q JOIN r ON q.host = r.host AND starts_with(path, prefix) GROUP BY 1) SELECT q.seq, coalesce(allow, true) AS allowed FROM q LEFT JOIN b USING (seq)",
    "o02_backoff": "SELECT k AS attempt, least(30, pow(2, k))::INT AS seconds FROM range(8) x(k)",
    "o66_accepted": f"{_R} SELECT id FROM rq WHERE status <> 'error' AND id % 4 <> 0",
    "o67_html_type": "SELECT * FROM (VALUES (0, true), (1, false), (2, true), (3, false), (4, false)) x(k, html)",
    "o10_price_changes": f"{_R} SELECT id, host AS product_id, value AS price, round(value - lag(value) OVER (PARTITION BY host ORDER BY ats, id), 2) AS change FROM rq WHERE status = 'purchase'",
    "o75_stream_fresh_urls": f"{_R} SELECT DISTINCT url_hash, host FROM rq",
    "o54o_stream_rates": f"{_R} SELECT date_trunc('hour', ats)::TIMESTAMP AS minute, count(*) AS pages, count(*) FILTER (status = 'failed') AS failed FROM rq GROUP BY 1",
    "o73_crawl_waves": "SELECT * FROM (VALUES ('https://www.kabum.com.br/hardware', 'Hardware', 0, false, NULL, NULL), ('https://www.kabum.com.br/produto/1/ssd-nvme', 'SSD NVMe 1TB', 1, true, 'SSD NVMe 1TB', 499.9::DOUBLE), ('https://www.kabum.com.br/produto/2/livro', 'Livro', 1, true, NULL, NULL)) x(url, title, depth, is_product_page, name, price)",
}
