"""Fetching over HTTP with the policies in force: robots, token bucket, retries, circuit breaker.

Requests are dealt by host, so a host's politeness is kept by one task at a time and hosts run side
by side: host_concurrency threads for the host of a task, and as many tasks as global_concurrency
leaves room for. Backoff has full jitter, drawn from a hash of url and attempt; a Retry-After of
seconds or an HTTP date wins over it. A host's breaker is asked once a page and told of a page's
last failure; answers of 4xx are no fault of the host. The transport is a function (url, timeout) -> (status, text, headers), given by the caller
or urllib; clock and sleep can be replaced, so tests need neither network nor time.
"""

from __future__ import annotations

import threading
import time
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from itertools import groupby
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.config import Settings
from lodestack.functions.urls import host_of
from lodestack.operators.policy import RETRYABLE, Breaker, Bucket, robots_verdict

Transport = Callable[[str, float], tuple[int, str, dict[str, str]]]
ADDED = "status_code int, text string, headers map<string,string>, retries int, waited double, reason string, requests int, bytes long, statuses map<string,int>, breaker string"


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds to wait by a Retry-After header, as the column function of this name says; now is epoch seconds."""
    text = (value or "").strip()
    try:
        return max(0.0, float(text))
    except ValueError:
        pass
    try:
        when = parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None
    return max(0.0, (when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp() - now)


def jitter(url: str, attempt: int, base: float, cap: float) -> float:
    """From 0 to the backoff's ceiling, the same in every run."""
    return min(cap, base * 2**attempt) * (zlib.crc32(f"{attempt}:{url}".encode()) / 2**32)


def urllib_transport(agent: str) -> Transport:
    """The standard library's client; error statuses are answers, not exceptions."""

    def get(url: str, timeout: float) -> tuple[int, str, dict[str, str]]:
        try:
            with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:  # noqa: S310
                return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), {k.lower(): v for k, v in r.headers.items()}
        except HTTPError as e:
            return e.code, "", {k.lower(): v for k, v in e.headers.items()}

    return get


def map_transport(pages: dict[str, str], robots: str | None = None, robots_status: int = 404) -> Transport:
    """Recorded answers by url; robots.txt as given."""

    def get(url: str, timeout: float) -> tuple[int, str, dict[str, str]]:
        if urlsplit(url).path == "/robots.txt":
            return (200, robots, {}) if robots is not None else (robots_status, "", {})
        return (200, pages[url], {}) if url in pages else (404, "", {})

    return get


@dataclass
class HostClient:
    """Everything that is kept for one host during a task."""

    settings: Settings
    transport: Transport
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    now: Callable[[], float] = lambda: datetime.now(UTC).timestamp()

    def __post_init__(self):
        s = self.settings
        self.breaker, self.bucket, self.lock = Breaker(s.breaker_threshold, s.breaker_reset), Bucket(s.requests_per_second), threading.RLock()
        self.robots: tuple[int | None, str] | None = None
        self.paced = False  # by the host's own crawl delay

    def _once(self, url: str) -> tuple[int | None, str, dict]:
        try:
            return self.transport(url, self.settings.timeout)
        except OSError:
            return None, "", {}

    def _allowed(self, url: str) -> bool:
        if not self.settings.respect_robots:
            return True
        with self.lock:
            if self.robots is None:
                parts = urlsplit(url)
                status, body, _ = self._once(f"{parts.scheme}://{parts.netloc}/robots.txt")
                self.robots = (status, body)
            ok, _, delay = robots_verdict(self.robots[1], self.robots[0], self.settings.user_agent, url, self.settings.crawl_delay)
            if delay and not self.paced:
                self.bucket, self.paced = Bucket(1 / max(delay, 0.01)), True
        return ok

    def get(self, url: str) -> tuple:
        """The columns of ADDED."""
        seen, size = Counter(), 0

        def row(status, text, headers, retries, waited, reason, requests) -> tuple:
            return status, text, headers, retries, waited, reason, requests, size, dict(seen), self.breaker.state

        if not self._allowed(url):
            return row(None, "", {}, 0, 0.0, "disallowed_by_robots", 0)
        with self.lock:
            if not self.breaker.admits(self.clock()):
                return row(None, "", {}, 0, 0.0, "circuit_open", 0)
        waited, most = 0.0, self.settings.max_retries
        for attempt in range(most + 1):
            with self.lock:
                pause = self.bucket.wait(self.clock())
            self.sleep(pause)
            waited += pause
            status, text, headers = self._once(url)
            size += len(text.encode())
            if status is not None:
                seen[str(status)] += 1
            again = status is None or status in RETRYABLE or status >= 500
            if not again or attempt == most:
                with self.lock:
                    if again or status < 400:
                        self.breaker.record(not again, self.clock())
                    else:
                        self.breaker.trial = False
                return row(status, text, headers, attempt, waited, "fetched" if status is not None else "unreachable", attempt + 1)
            asked = retry_after(headers.get("retry-after"), self.now())
            pause = jitter(url, attempt, self.settings.retry_base, self.settings.retry_cap) if asked is None else asked
            self.sleep(pause)
            waited += pause
        raise AssertionError("unreachable")


def fetch(requests: DataFrame, transport: Transport | None = None, settings: Settings | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests (url, ...) with the columns of ADDED."""
    s = settings or Settings()
    get = transport or urllib_transport(s.user_agent)
    base = requests.withColumn("_host", host_of(requests["url"]))
    schema = T.StructType([*requests.schema.fields, *T.StructType.fromDDL(ADDED).fields])
    names = [f.name for f in T.StructType.fromDDL(ADDED)]
    lanes = min(s.host_concurrency, s.global_concurrency)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, client = None, None
        with ThreadPoolExecutor(lanes) as pool:
            for frame in frames:
                rows = []
                for own, urls in groupby(zip(frame["_host"], frame["url"], strict=True), key=lambda x: x[0]):
                    if client is None or own != host:
                        host, client = own, HostClient(s, get, clock, sleep)
                    each = [u for _, u in urls]
                    rows += [client.get(u) for u in each] if lanes == 1 else pool.map(client.get, each)
                yield pd.concat([frame.drop(columns="_host"), pd.DataFrame(rows, columns=names, index=frame.index, dtype=object)], axis=1)

    return base.repartition(max(1, s.global_concurrency // lanes), "_host").sortWithinPartitions("_host", "url").mapInPandas(run, schema)


def request_log(fetched: DataFrame) -> DataFrame:
    """One row: requests, retries, failures, robots_denied, circuit_skips, bytes_downloaded, the map of statuses and the last breaker state of each host that is not closed."""
    reason, status = F.col("reason"), F.col("status_code")
    bad = ~reason.isin("disallowed_by_robots", "circuit_open") & (status.isNull() | (status >= 400))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    totals = fetched.agg(
        zero("requests").alias("requests"), zero("retries").alias("retries"), F.count_if(bad).alias("failures"), F.count_if(reason == "disallowed_by_robots").alias("robots_denied"),
        F.count_if(reason == "circuit_open").alias("circuit_skips"), zero("bytes").alias("bytes_downloaded"),
    )
    named = lambda k, v: F.coalesce(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))))
    by = fetched.select(F.explode("statuses").alias("status", "n")).groupBy("status").agg(F.sum("n").alias("n")).agg(named("status", "n").alias("statuses"))
    hosts = fetched.groupBy(host_of(F.col("url")).alias("host")).agg(F.max_by("breaker", "url").alias("state")).where("state <> 'closed'").agg(named("host", "state").alias("breakers"))
    return totals.crossJoin(F.broadcast(by)).crossJoin(F.broadcast(hosts))  # one row each
