"""Fetch policies replayed over event logs, host by host, in time order.

A host's log is cut into an ordered stream of Arrow batches; state is a few numbers, so a hot host
needs time in its task but no memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.errors import ConfigError
from lodestack.functions.urls import host_of, robots_url

#: Statuses worth another try, and those that are not.
RETRYABLE = [408, 425, 429, 500, 502, 503, 504, 522, 524]
FATAL = [400, 401, 403, 404, 405, 410, 451]


# retries -------------------------------------------------------------------------------------


def status_class(status: Column) -> Column:
    """ok, retry, fatal or other."""
    return F.when(status.isin(*RETRYABLE) | (status >= 500), "retry").when(status.isin(*FATAL), "fatal").when(status.between(200, 399), "ok").otherwise("other")


def backoff_ceiling(attempt: Column, base: float = 0.5, cap: float = 30.0) -> Column:
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt))


def backoff(attempt: Column, key: Column, base: float = 0.5, cap: float = 30.0, retry_after: Column | None = None) -> Column:
    """Full jitter: a number from 0 to the ceiling, drawn from a hash of key and attempt; Retry-After wins."""
    unit = F.pmod(F.xxhash64(key, attempt), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wait = unit * backoff_ceiling(attempt, base, cap)
    return wait if retry_after is None else F.coalesce(retry_after, wait)


# circuit breaker -----------------------------------------------------------------------------


@dataclass
class Breaker:
    """Closed until threshold failures in a row; open for reset seconds; then one trial decides."""

    threshold: int = 8
    reset: float = 60.0
    state: str = "closed"
    failures: int = 0
    opened: float = 0.0
    trial: bool = False

    def __post_init__(self):
        if self.threshold < 1:
            raise ConfigError("threshold must be at least 1")

    def at(self, now: float) -> str:
        if self.state == "open" and now - self.opened >= self.reset:
            self.state, self.trial = "half_open", False
        return self.state

    def admits(self, now: float) -> bool:
        state = self.at(now)
        if state == "half_open" and not self.trial:
            self.trial = True
            return True
        return state == "closed"

    def record(self, ok: bool, now: float) -> None:
        self.trial = False
        if ok:
            self.state, self.failures = "closed", 0
            return
        if self.state != "half_open":
            self.failures += 1
        if self.state == "half_open" or self.failures >= self.threshold:
            self.state, self.opened = "open", now


def _by_host(events: DataFrame, columns: list[str], schema: str, start, step) -> DataFrame:
    """Fold each host's events in the order of (ts, seq): start() makes a state, step(state, row) a tuple of new columns."""
    new = [f.split()[0] for f in schema.split(", ")]
    kinds = dict(events.select("host", *columns).dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in ["host", *columns]) + ", " + schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, state = None, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if state is None or row.host != host:
                    host, state = row.host, start()
                out.append(step(state, row))
            yield pd.concat([frame, pd.DataFrame(out, columns=new, index=frame.index, dtype=object)], axis=1)

    ordered = events.select("host", *columns).repartition("host").sortWithinPartitions("host", "ts", "seq")
    return ordered.mapInPandas(run, ddl)


def replay_breaker(events: DataFrame, threshold: int = 8, reset: float = 60.0) -> DataFrame:
    """events (host, ts seconds, seq, ok) with allowed and the state after each; events that are not allowed change nothing."""

    def step(b: Breaker, row):
        allowed = b.admits(row.ts)
        if allowed:
            b.record(bool(row.ok), row.ts)
        return allowed, b.state

    Breaker(threshold, reset)
    return _by_host(events, ["ts", "seq", "ok"], "allowed boolean, state string", lambda: Breaker(threshold, reset), step)


def reset_breakers(states: DataFrame, *hosts: str) -> DataFrame:
    """states (host, state) with these hosts closed again, or all of them if none is named."""
    own = F.col("host").isin(*hosts) if hosts else F.lit(True)
    return states.withColumn("state", F.when(own, F.lit("closed")).otherwise(F.col("state")))


def breaker_states(replayed: DataFrame) -> DataFrame:
    """The last state of each host as one map, sorted by host."""
    last = replayed.groupBy("host").agg(F.max_by("state", F.struct("ts", "seq")).alias("state"))
    return last.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("host", "state")))).alias("breakers"))


# token bucket --------------------------------------------------------------------------------


@dataclass
class Bucket:
    rate: float
    capacity: float | None = None
    tokens: float = 0.0
    updated: float | None = None

    def __post_init__(self):
        if self.rate <= 0:
            raise ConfigError("rate must be positive")
        self.capacity = max(1.0, self.rate) if self.capacity is None else self.capacity
        self.tokens = self.capacity

    def wait(self, now: float, amount: float = 1.0) -> float:
        """Seconds until amount can be taken at now or after; takes it."""
        if amount > self.capacity:
            raise ConfigError("no bucket of this capacity ever holds that amount")
        if self.updated is None:
            self.updated = now
        if now > self.updated:
            self.tokens, self.updated = min(self.capacity, self.tokens + (now - self.updated) * self.rate), now
        ready = self.updated + max(0.0, (amount - self.tokens) / self.rate)
        self.tokens = self.tokens + (ready - self.updated) * self.rate - amount
        self.updated = ready
        return ready - now


def replay_bucket(events: DataFrame, rate: float, capacity: float | None = None) -> DataFrame:
    """events (host, ts seconds, seq) with waited, the seconds each had to wait for a token of its host."""
    Bucket(rate, capacity)
    return _by_host(events, ["ts", "seq"], "waited double", lambda: Bucket(rate, capacity), lambda b, row: (float(b.wait(row.ts)),))


# robots --------------------------------------------------------------------------------------

VERDICT = "struct<allowed:boolean,reason:string,crawl_delay:double>"


def robots_verdict(body: str | None, status: int | None, agent: str, url: str, default_delay: float | None = None) -> tuple[bool, str, float | None]:
    """By a robots.txt answer: 4xx allows all, 5xx or no answer forbids all."""
    if status is None or status >= 500:
        return False, "disallowed_by_robots", None
    if status >= 400:
        return True, "allowed", default_delay
    parser = RobotFileParser()
    parser.parse((body or "").splitlines())
    if not parser.can_fetch(agent, url):
        return False, "disallowed_by_robots", None
    delay = parser.crawl_delay(agent) or parser.crawl_delay("*")
    return True, "allowed", default_delay if delay is None else float(delay)


def check_robots(urls: DataFrame, answers: DataFrame, agent: str, default_delay: float | None = None) -> DataFrame:
    """urls (url) with verdict, by answers (host, status, body), one per host."""

    @F.pandas_udf(VERDICT)
    def verdicts(url: pd.Series, status: pd.Series, body: pd.Series) -> pd.DataFrame:
        rows = [robots_verdict(b, None if pd.isna(s) else int(s), agent, u, default_delay) for u, s, b in zip(url, status, body, strict=True)]
        return pd.DataFrame(rows, columns=["allowed", "reason", "crawl_delay"])

    known = answers.select("host", F.col("status").alias("_status"), F.col("body").alias("_body"))
    joined = urls.withColumn("host", host_of(F.col("url"))).join(known, "host", "left")
    return joined.withColumn("verdict", verdicts("url", F.col("_status").cast("double"), "_body")).drop("_status", "_body").withColumn("robots_url", robots_url(F.col("url")))
