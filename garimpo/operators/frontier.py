"""The crawl frontier: admission, domain-balanced scheduling, status, politeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import url as U
from garimpo.functions.stores import DEFAULT_DELAY, MAX_DEPTH, STORES


def items(urls: DataFrame, stores=None) -> DataFrame:
    """Frontier rows of ``urls(url, depth, seq)``."""
    return urls.select("seq", U.url_item("url", "depth", stores).alias("item")).select("seq", "item.*")


def admit(candidates: DataFrame, seen: DataFrame, max_depth: int = MAX_DEPTH, stores=None) -> DataFrame:
    """Candidates that are allowed, not too deep and not seen; the first by seq of each url_hash."""
    fine = items(candidates.where(F.col("depth") <= max_depth), stores).where(U.is_allowed("url", stores))
    first = fine.groupBy("url_hash").agg(F.min_by(F.struct("seq", "url", "domain", "depth", "priority"), "seq").alias("x")).select("url_hash", "x.*")
    return first.join(seen.select("url_hash"), "url_hash", "left_anti")


def scheduled(pending: DataFrame, n: int) -> DataFrame:
    """A batch of ``n`` of pending(seq, domain, priority): by priority and seq, at most n // domains of one domain, topped up from the rest.

    Only each domain's first n rows can be in the batch, so the rank is cut there before the global order.
    """
    w = Window.partitionBy("domain").orderBy(F.col("priority").desc(), "seq")
    cap = F.greatest(F.lit(1), F.expr(f"{n} div domains"))
    domains = pending.agg(F.greatest(F.countDistinct("domain"), F.lit(1)).alias("domains"))
    ranked = pending.withColumn("rd", F.row_number().over(w)).where(F.col("rd") <= n).crossJoin(F.broadcast(domains))
    return ranked.orderBy(F.col("rd") > cap, F.col("priority").desc(), "seq").limit(n).drop("rd", "domains")


def dequeue(frontier: DataFrame, n: int, domain: str | None = None) -> DataFrame:
    found = frontier.where("status = 'pending'")
    if domain:
        found = found.where(F.col("domain") == domain)
    return found.orderBy(F.col("priority").desc(), "added_at", "id").limit(n)


def latest_status(events: DataFrame, key: str = "url_hash") -> DataFrame:
    """Status of each URL from append-only events(key, status, at, id): the last; failures are counted as retries."""
    last = F.max_by("status", F.struct("at", "id"))
    return events.groupBy(key).agg(last.alias("status"), F.count_if(F.col("status") == "failed").alias("retries"), F.max(F.when(F.col("status") == "done", F.col("at"))).alias("processed_at"))


def status_counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def unseen(candidates: DataFrame, seen: DataFrame, key: str = "url_hash") -> DataFrame:
    """Rows whose key isn't in ``seen``, the smallest seq of each key."""
    w = Window.partitionBy(key).orderBy("seq")
    return candidates.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").join(seen.select(key).distinct(), key, "left_anti")


def permitted_times(requests: DataFrame, delay: Column | float, host: str = "host", at: str = "at", order: str = "seq") -> DataFrame:
    """When each request may go: a host's requests in order, each at its arrival or ``delay`` after the one before.

    t_i = max(a_i, t_(i-1) + d) equals max over j <= i of (a_j - j d), plus i d: a running maximum.
    """
    delay = F.lit(delay) if isinstance(delay, (int, float)) else delay
    w = Window.partitionBy(host).orderBy(at, order)
    i = F.row_number().over(w)
    return requests.withColumn("_i", i).withColumn("_d", delay.cast("double")).withColumn("slack", F.max(F.col(at) - F.col("_i") * F.col("_d")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("go_at", F.col("slack") + F.col("_i") * F.col("_d")).drop("_i", "_d", "slack")


def delay_of(url: Column | str, stores=None) -> Column:
    """The shop's delay, or the default."""
    out = None
    for s in STORES if stores is None else stores:
        test = U.domain(url) == s.domain
        out = F.when(test, s.request_delay) if out is None else out.when(test, s.request_delay)
    return out.otherwise(DEFAULT_DELAY)


def politeness_stats(requests: DataFrame, host: str = "host") -> DataFrame:
    return requests.groupBy(host).agg(F.count(F.lit(1)).alias("requests"), F.max("delay").alias("delay"), F.bool_or("robots_fetched").alias("robots_fetched"))


def robots_allowed(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests(host, path, seq) with allowed by rules(host, prefix, allow): the longest prefix wins, allow wins ties, no rule allows."""
    met = requests.alias("q").join(rules.alias("r"), (F.col("q.host") == F.col("r.host")) & F.col("q.path").startswith(F.col("r.prefix")), "left")
    best = met.groupBy("q.seq").agg(F.max_by("r.allow", F.struct(F.length("r.prefix"), "r.allow")).alias("allow"))
    return requests.join(best, "seq").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


def crawl_counters(log: DataFrame) -> DataFrame:
    """Pages crawled and failed, bytes, and pages a minute of each domain from log(domain, ok, bytes, at)."""
    seconds = F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))
    return log.groupBy("domain").agg(F.count_if("ok").alias("crawled"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.round(F.when(seconds > 0, F.count_if("ok") * 60e6 / seconds), 2).alias("pages_per_minute"))


def clock(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.expr("1") * F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
