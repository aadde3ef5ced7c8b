"""Crawl and re-parse as plans: one DataFrame per level, one merge per run.

A run's pages, items and failures are written before they are used again, so no level is fetched
or parsed twice and a lost executor costs a reread.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.config import Settings
from lodestack.operators import frontier, merge
from lodestack.schemas import CRAWL_RUNS, FETCH_ERRORS, TABLES, conform
from lodestack.sources import archive
from lodestack.sources.http import request_log
from lodestack.sources.tables import Table

Fetch = Callable[[DataFrame], DataFrame]
#: Column by which a table's folders are cut.
PARTITIONS = {"job_items": "source", "raw_pages": "adapter"}


@dataclass
class RunResult:
    adapter: str
    status: str = "running"
    pages_fetched: int = 0
    requests_made: int = 0
    retries: int = 0
    failures: int = 0
    items_seen: int = 0
    items_new: int = 0
    items_changed: int = 0
    items_unchanged: int = 0
    max_depth_reached: int = 0
    duration_seconds: float = 0.0
    detail: dict = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)

    def summary(self) -> str:
        return (
            f"{self.adapter} {self.status} after {self.duration_seconds:.1f} s: {self.pages_fetched} pages, {self.items_seen} items "
            f"({self.items_new} new, {self.items_changed} changed, {self.items_unchanged} unchanged), {self.failures} failures"
        )

    def payload(self) -> str:
        """Counters and the first errors as JSON."""
        return json.dumps(asdict(self) | {"errors": self.errors[:20]}, sort_keys=True, default=str)


class Store:
    """The four tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._scratch: list[str] = []
        self.tables = {name: Table(spark, f"{self.root}/{name}", schema, PARTITIONS.get(name)) for name, schema in TABLES.items()}

    def read(self, name: str, *values: str) -> DataFrame:
        """A table, or its partitions of these values."""
        return self.tables[name].read(values or None)

    def clean(self) -> None:
        """Delete what scratch() wrote."""
        while self._scratch:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._scratch.pop())
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def top(self, name: str) -> int:
        """The largest id, from the id column alone."""
        return self.read(name).agg(F.max("id")).first()[0] or 0

    def scratch(self, df: DataFrame, label: str) -> DataFrame:
        """df written under the store and read again."""
        path = f"{self.root}/scratch/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._scratch.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, name: str, df: DataFrame) -> None:
        """Append rows, with ids after the largest where they have none."""
        table = self.tables[name]
        keys = [c for c in ("url", "run_id", "fetched_at", "error", "created_at") if c in table.schema.names]
        with table.lock():
            table.append(merge.number(conform(df, table.schema), self.top(name), keys))

    def start_run(self, adapter: str, at: datetime) -> int:
        table = self.tables["crawl_runs"]
        with table.lock():
            run_id = self.top("crawl_runs") + 1
            row = conform(self.spark.createDataFrame([(run_id, adapter, at)], "id long, adapter string, started_at timestamp").withColumns({"status": F.lit("running"), "created_at": F.col("started_at")}), CRAWL_RUNS)
            table.append(row)
        return run_id

    def finish_run(self, run_id: int, result: RunResult, at: datetime) -> None:
        known = {k: v for k, v in asdict(result).items() if k in CRAWL_RUNS.names and k != "detail"} | {"duration_seconds": round(result.duration_seconds, 3), "detail": json.dumps(result.detail, sort_keys=True), "finished_at": at}
        table = self.tables["crawl_runs"]
        with table.lock():
            own = F.col("id") == run_id
            table.publish(table.read().select(*[F.when(own, F.lit(known[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in known else F.col(f.name) for f in CRAWL_RUNS]))

    def record_errors(self, run_id: int, failures: DataFrame, at: datetime) -> None:
        """failures (url, error); messages are cut to 2000 characters."""
        self.add("fetch_errors", conform(failures.select("url", F.substring("error", 1, 2000).alias("error")).withColumns({"run_id": F.lit(run_id), "created_at": F.lit(at)}), FETCH_ERRORS))

    def clear_errors(self, run_id: int) -> None:
        table = self.tables["fetch_errors"]
        with table.lock():
            table.publish(table.read().where(~F.col("run_id").eqNullSafe(F.lit(run_id))))

    def upsert(self, items: DataFrame, seen_at: datetime, run_id: int | None, stale_source: str | None = None, touch_unchanged: bool = False) -> tuple[dict, int]:
        """Merge items and, with stale_source, flag what they do not contain. Returns outcomes and how many were flagged.

        Only the partitions of the batch's sources are read and written.
        """
        table = self.tables["job_items"]
        with table.lock():
            batch = self.scratch(merge.last_of_each(merge.to_rows(items, seen_at, run_id)), "batch")
            sources = sorted({r["source"] for r in batch.select("source").distinct().collect()} | ({stale_source} if stale_source else set()))  # names of adapters
            target = table.read(sources)
            stats = merge.write_stats(merge.classify(target, batch)).first().asDict()
            flagged = 0
            if stats["total"] == 0:
                return stats, 0
            merged = merge.merge(target, batch, touch_unchanged, self.top("job_items"))
            if stale_source is not None:
                merged = self.scratch(merged, "merged")
                after = merge.mark_stale(merged, stale_source, batch.where(F.col("source") == stale_source), run_id)
                flagged = merge.stale_count(merged, after)
                merged = after
            table.replace(merged, sources)
        return stats, flagged


def crawl(store: Store, adapter, fetch: Fetch, as_of: datetime, settings: Settings | None = None, max_pages: int | None = None) -> RunResult:
    """Traverse a source level by level, archive its pages, merge its items, flag what is gone.

    fetch answers follow-ups with status_code and text beside their own columns. A page that does
    not answer 2xx, or that the parser fails on, is a failure and the run goes on. Where an adapter
    can look ahead in what is recorded, all levels are one, with the verdicts of a queue.
    """
    settings = settings or Settings()
    budget, began = max_pages or settings.max_pages, time.monotonic()
    spark, result = store.spark, RunResult(adapter.name)
    run_id = store.start_run(adapter.name, as_of)
    level, seen, items, failures = adapter.start(spark), None, None, None
    asked = 0
    skipped: dict[str, int] = {"duplicates_skipped": 0, "too_deep_skipped": 0, "over_budget": 0}
    try:
        ahead = adapter.ahead(spark, fetch, settings.max_depth, store.scratch) if hasattr(adapter, "ahead") else None
        for depth in range(settings.max_depth + 2 if ahead is None else 1):
            level = level.withColumn("depth", F.lit(depth)) if ahead is None else ahead
            if "base_url" in level.columns:
                level = frontier.on_site(level)
            past = seen if seen is not None else spark.createDataFrame([], "canon string")
            admitted = store.scratch(frontier.admit(level, past, settings.max_depth, budget - asked), f"level-{depth}")
            if ahead is not None:
                # verdicts down to the first index page that is not queued are final, and nothing below it is reached
                last = admitted.where("kind = 'list' and verdict <> 'queued'").agg(F.min("depth")).first()[0]
                admitted = admitted if last is None else admitted.where(F.col("depth") <= last)
            counted = frontier.stats(admitted)
            skipped = {"duplicates_skipped": skipped["duplicates_skipped"] + counted.duplicates, "too_deep_skipped": skipped["too_deep_skipped"] + counted.too_deep, "over_budget": skipped["over_budget"] + counted.over_budget}
            if not counted.queued:
                break
            result.max_depth_reached = counted.max_depth_reached
            queued = admitted.where("verdict = 'queued'").drop("verdict")
            seen = queued.select("canon") if seen is None else seen.union(queued.select("canon"))
            pages = store.scratch(fetch(queued).withColumn("fetched_at", F.lit(as_of).cast("timestamp")), f"pages-{depth}")
            ok = pages.where("status_code between 200 and 299")
            got = pages.agg(F.count("*").alias("n"), F.count_if(F.col("status_code").between(200, 299)).alias("ok"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
            if "requests" in pages.columns:
                log = request_log(pages).first()
                result.requests_made += log["requests"]
                result.retries += log["retries"]
                for name in ("robots_denied", "circuit_skips"):
                    result.detail[name] = result.detail.get(name, 0) + log[name]
                for status, n in log["statuses"].items():
                    by = result.detail.setdefault("statuses", {})
                    by[status] = by.get(status, 0) + n
                result.detail["breakers"] = log["breakers"]
            else:
                result.requests_made += got["n"]
            asked += got["n"]
            result.pages_fetched += got["ok"]
            result.failures += got["n"] - got["ok"]
            result.detail["bytes_downloaded"] = result.detail.get("bytes_downloaded", 0) + got["bytes"]
            said = F.format_string("HTTP %s for %s", F.col("status_code").cast("string"), "url")
            if "reason" in pages.columns:
                said = F.when(F.col("status_code").isNull(), F.concat_ws(" ", "reason", F.lit("for"), "url")).otherwise(said)
            bad = pages.where("not coalesce(status_code between 200 and 299, false)").select("url", said.alias("error"))
            failures = bad if failures is None else failures.unionByName(bad)
            if settings.archive:
                carried = [c for c in ok.columns if c not in ("text", "status_code", "canon", "fetched_at")]
                rows = archive.build_pages(ok.withColumn("headers", F.create_map().cast("map<string,string>")) if "headers" not in ok.columns else ok)
                rows = rows.join(ok.select("url", F.to_json(F.struct(*carried)).alias("meta")), "url", "left")
                store.add("raw_pages", archive.archive_rows(rows, adapter.name, settings.snapshot_max_bytes))
            read = store.scratch(adapter.parsed(ok), f"parsed-{depth}")
            broken = read.where("error is not null").select("url", "error")
            result.failures += broken.count()
            failures = failures.unionByName(broken)
            own = store.scratch(adapter.items(read), f"items-{depth}")
            items = own if items is None else items.unionByName(own)
            level = adapter.follows(read)
        if items is not None:
            result.items_seen = items.count()
            any_seen = result.items_seen > 0
            start = time.monotonic()
            stats, flagged = store.upsert(items, as_of, run_id, adapter.name if any_seen else None)
            result.detail["write_seconds"] = round(time.monotonic() - start, 3)
            result.items_new, result.items_changed, result.items_unchanged = stats["new"], stats["changed"], stats["unchanged"]
            result.detail["marked_inactive"] = flagged
        if failures is not None and result.failures:
            store.record_errors(run_id, failures, as_of)
            result.errors = [r["error"] for r in failures.orderBy("url").limit(20).collect()]
        result.status = "succeeded"
    except Exception:
        result.status = "failed"
        raise
    finally:
        result.detail |= skipped
        result.duration_seconds = time.monotonic() - began
        store.finish_run(run_id, result, as_of)
        store.clean()
    return result


def reparse(store: Store, adapter, as_of: datetime, limit: int = 1000, first_only: bool = False) -> RunResult:
    """Parse the newest archived body of each url again and merge; no page is fetched.

    The follow-up a page answered is stored with it, so every stage of every source can be parsed
    again. Nothing is flagged stale if nothing was parsed.
    """
    run_id, result, began = store.start_run(adapter.name, as_of), RunResult(adapter.name), time.monotonic()
    own = store.read("raw_pages", adapter.name)
    newest = archive.latest(own)
    if newest.select("url").count() > limit:
        newest = newest.join(archive.urls(own, limit=limit).select("url"), "url", "left_semi")
    schema = adapter.FOLLOW.replace("url string, ", "", 1).replace("kind string, ", "", 1)
    pages = archive.replayed(newest).withColumn("_f", F.from_json("meta", schema)).select("url", "kind", "status_code", "text", "_f.*")
    read = store.scratch(adapter.parsed(pages), "replayed")
    result.pages_fetched, result.failures = read.count(), read.where("error is not null").count()
    items = store.scratch(adapter.items(read), "items")
    if first_only:
        items = items.groupBy("source", "url").agg(F.min_by(F.struct(*[c for c in items.columns if c not in ("source", "url")]), "external_id").alias("_r")).select("source", "url", "_r.*").select(*items.columns)
    result.items_seen = items.count()
    if result.items_seen:
        stats, flagged = store.upsert(items, as_of, run_id, adapter.name)
        result.items_new, result.items_changed, result.items_unchanged = stats["new"], stats["changed"], stats["unchanged"]
        result.detail["marked_inactive"] = flagged
    result.status, result.duration_seconds = "succeeded", time.monotonic() - began
    store.finish_run(run_id, result, as_of)
    store.clean()
    return result


