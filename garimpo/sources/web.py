"""Live sources: pages and robots.txt over HTTP, fetched by executors."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.stores import CONTENT_TYPES, USER_AGENT

RETRY_STATUS = {408, 429, 500, 502, 503, 504}
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, TIMEOUT, ROBOTS_TIMEOUT, ERROR_LENGTH = 3, 1, 30, 30, 10, 200
RESULT = "url string, status_code int, content_type string, html string, content_length int, crawl_time_ms int, error string"


def backoff(attempt: Column | str) -> Column:
    """Seconds to wait before a further attempt: 1, 2, 4, ... 30 at most."""
    return F.least(F.lit(LONGEST_WAIT), F.lit(FIRST_WAIT) * F.pow(F.lit(2), F.col(attempt) if isinstance(attempt, str) else attempt)).cast("int")


def http_get(url: str, timeout: float = TIMEOUT) -> tuple[int, str, bytes, str | None]:
    """Status, content type, body and charset."""
    request = urllib.request.Request(url, headers={"User-Agent": USER_AGENT, "Accept": "text/html,application/xhtml+xml", "Accept-Language": "pt-BR,pt;q=0.9,en;q=0.8"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.headers.get("Content-Type", ""), r.read(), r.headers.get_content_charset()
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type", "") if e.headers else "", b"", None


def fetch_one(url: str, get: Callable = http_get, wait: Callable = time.sleep) -> tuple:
    """A row of RESULT; every failure is an error text, never an exception."""
    began = time.time()
    for attempt in range(ATTEMPTS):
        try:
            status, kind, body, charset = get(url)
            if status in RETRY_STATUS and attempt < ATTEMPTS - 1:
                wait(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt))
                continue
            took = int((time.time() - began) * 1000)
            if not any(t in kind.lower() for t in CONTENT_TYPES):
                return url, status, kind, None, 0, took, f"content type {kind}"[:ERROR_LENGTH]
            html = body.decode(charset or "utf-8", "replace")
            return url, status, kind, html, len(html), took, None
        except TimeoutError:
            error = "Timeout"
        except Exception as e:  # noqa: BLE001  what a page does must not end the job
            error = str(e)[:ERROR_LENGTH]
        if attempt < ATTEMPTS - 1:
            wait(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt))
    return url, None, None, None, 0, int((time.time() - began) * 1000), error


def fetch(urls: DataFrame, get: Callable = http_get, delay: float = 0.2, hosts: int = 64) -> DataFrame:
    """Fetch ``urls(url, host)``: a host's pages in one task, one after another with ``delay`` seconds between.

    A column ``delay`` has the seconds for each page instead, and a column ``last_at`` when the host was last asked
    before (seconds since 1970, NULL if never).
    """
    columns = ["url", "host", F.col("delay").cast("double").alias("delay") if "delay" in urls.columns else F.lit(float(delay)).alias("delay"), F.col("last_at").cast("double").alias("last_at") if "last_at" in urls.columns else F.lit(None).cast("double").alias("last_at")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                before = last.get(r.host, r.last_at if r.last_at == r.last_at and r.last_at is not None else 0)
                pause = before + r.delay - time.time()
                if pause > 0:
                    time.sleep(pause)
                last[r.host] = time.time()
                rows.append(fetch_one(r.url, get))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return urls.select(*columns).repartition(hosts, "host").mapInPandas(run, RESULT)


def robots(hosts: DataFrame, get: Callable = http_get) -> DataFrame:
    """host, fetched and text of robots.txt for hosts(host, scheme); none means no rules."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    status, _, body, _ = get(f"{r.scheme}://{r.host}/robots.txt", ROBOTS_TIMEOUT) if get is http_get else get(f"{r.scheme}://{r.host}/robots.txt")
                    rows.append((r.host, status == 200, body.decode("utf-8", "replace") if status == 200 else None))
                except Exception:  # noqa: BLE001
                    rows.append((r.host, False, None))
            yield pd.DataFrame(rows, columns=["host", "fetched", "text"])

    return hosts.select("host", "scheme").mapInPandas(run, "host string, fetched boolean, text string")


def robots_udf(agent: str = USER_AGENT):
    """Whether a robots.txt text lets the agent fetch a path; no text lets it."""

    @F.pandas_udf("boolean")
    def allowed(text: pd.Series, path: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}

        def one(t: str | None, p: str) -> bool:
            if not isinstance(t, str) or not t:
                return True
            if t not in parsed:
                parsed[t] = RobotFileParser()
                parsed[t].parse(t.splitlines())
            return parsed[t].can_fetch(agent, p or "/")

        return pd.Series([one(t, p) for t, p in zip(text, path, strict=True)])

    return allowed


def accepted(results: DataFrame) -> DataFrame:
    """Fetched pages without error and with status 200."""
    return results.where("error is null and status_code = 200")


def html_type(kind: Column | str) -> Column:
    kind = F.lower(F.col(kind) if isinstance(kind, str) else kind)
    return F.coalesce(F.contains(kind, F.lit(CONTENT_TYPES[0])) | F.contains(kind, F.lit(CONTENT_TYPES[1])), F.lit(False))
