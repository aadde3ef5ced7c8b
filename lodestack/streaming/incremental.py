"""The batch operators as streams: merge by micro-batch, windowed days, url dedup, breaker state.

Event times must be TIMESTAMP: watermarks refuse TIMESTAMP_NTZ, so readers of files cast first.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from lodestack.functions.urls import canonical_url
from lodestack.operators.policy import Breaker, Bucket
from lodestack.plans.pipeline import Store


def timed(df: DataFrame, column: str = "ts") -> DataFrame:
    """df with the column as TIMESTAMP."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def merge_stream(items: DataFrame, store: Store, seen_at: datetime, checkpoint: str, run_id: int | None = None) -> DataStreamWriter:
    """Upsert every micro-batch; a batch that is replayed after a failure finds its rows unchanged."""

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch, seen_at, run_id)
            store.clean()

    return items.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def daily_counts(df: DataFrame, column: str = "ts", late: str = "1 day", *keys: str) -> DataFrame:
    """Tumbling day windows (day, keys, n) with a watermark."""
    return df.withWatermark(column, late).groupBy(F.window(column, "1 day"), *keys).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), *keys, "n")


def new_urls(df: DataFrame, column: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each canonical url within the watermark."""
    return df.withColumn("canon", canonical_url(F.col("url"))).withWatermark(column, late).dropDuplicatesWithinWatermark(["canon"])


def last_seen(df: DataFrame, *keys: str, column: str = "ts") -> DataFrame:
    """The newest time of each key, for update or complete mode."""
    return df.groupBy(*keys).agg(F.max(column).alias("last_seen_at"), F.count("*").alias("n"))


BREAKER_OUT = "host string, ts double, allowed boolean, state string"


class BreakerProcessor(StatefulProcessor):
    """A circuit breaker per host over a stream of (host, ts seconds, ok)."""

    def __init__(self, threshold: int = 8, reset: float = 60.0):
        self.threshold, self.reset = threshold, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("breaker", "state string, failures int, opened double, trial boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        b = Breaker(self.threshold, self.reset)
        if self.kept.exists():
            b.state, b.failures, b.opened, b.trial = self.kept.get()
        out = []
        for r in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples(index=False):
            allowed = b.admits(r.ts)
            if allowed:
                b.record(bool(r.ok), r.ts)
            out.append((key[0], float(r.ts), allowed, b.state))
        self.kept.update((b.state, b.failures, float(b.opened), b.trial))
        yield pd.DataFrame(out, columns=["host", "ts", "allowed", "state"])

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, threshold: int = 8, reset: float = 60.0) -> DataFrame:
    """Needs the RocksDB state store."""
    return events.groupBy("host").transformWithStateInPandas(BreakerProcessor(threshold, reset), BREAKER_OUT, "Append", "None")


BUCKET_OUT = "host string, ts double, waited double"


class BucketProcessor(StatefulProcessor):
    """A token bucket per host over a stream of (host, ts seconds)."""

    def __init__(self, rate: float, capacity: float | None = None):
        self.rate, self.capacity = rate, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("bucket", "tokens double, updated double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        b = Bucket(self.rate, self.capacity)
        if self.kept.exists():
            b.tokens, b.updated = self.kept.get()
        asked = pd.concat(list(rows))["ts"].sort_values(kind="stable")
        out = [(key[0], float(t), float(b.wait(t))) for t in asked]
        self.kept.update((float(b.tokens), float(b.updated)))
        yield pd.DataFrame(out, columns=["host", "ts", "waited"])

    def close(self) -> None:
        pass


def bucket_stream(requests: DataFrame, rate: float, capacity: float | None = None) -> DataFrame:
    """Needs the RocksDB state store."""
    Bucket(rate, capacity)
    return requests.groupBy("host").transformWithStateInPandas(BucketProcessor(rate, capacity), BUCKET_OUT, "Append", "None")


STALE_OUT = "source string, external_id string, is_active boolean, at timestamp"


class StaleProcessor(StatefulProcessor):
    """Tells when a listing is first seen, and when it has not been seen for a while of event time."""

    def __init__(self, after_seconds: float):
        self.after = int(after_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = int(max(frame["ts"].max() for frame in rows).timestamp() * 1000)
        known = self.seen.get() if self.seen.exists() else None
        if known:
            last = max(last, known[0])
            self.handle.deleteTimer(known[1])
        timer = last + self.after
        self.handle.registerTimer(timer)
        self.seen.update((last, timer))
        yield self._row(key, True, last) if known is None else pd.DataFrame([], columns=["source", "external_id", "is_active", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = self.seen.get()[1]
        self.seen.clear()
        yield self._row(key, False, at)

    @staticmethod
    def _row(key, active: bool, ms: int) -> pd.DataFrame:
        return pd.DataFrame({"source": [key[0]], "external_id": [key[1]], "is_active": [active], "at": [pd.Timestamp(ms, unit="ms")]})

    def close(self) -> None:
        pass


def stale_stream(items: DataFrame, after_seconds: float, late: str = "0 seconds") -> DataFrame:
    """items (source, external_id, ts) become changes of is_active. Needs the RocksDB state store."""
    keyed = items.select("source", "external_id", "ts").withWatermark("ts", late).groupBy("source", "external_id")
    return keyed.transformWithStateInPandas(StaleProcessor(after_seconds), STALE_OUT, "Append", "EventTime")
