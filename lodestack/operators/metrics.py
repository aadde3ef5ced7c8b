"""Counters of runs and requests, and their text for monitoring systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.rollups import bucket_counts

# Bucket bounds in seconds.
LATENCY = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]
WAIT = [0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 15.0]
DURATION = [1.0, 5.0, 15.0, 30.0, 60.0, 120.0, 300.0, 600.0, 1800.0]
WRITE = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0]


def counters(runs: DataFrame) -> DataFrame:
    """name, adapter, value: totals over runs."""
    sums = {"pages_fetched": "pages_fetched_total", "retries": "retries_total", "items_seen": "items_seen_total", "failures": "failures_total"}
    wide = runs.groupBy("adapter").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in sums.items()], *[F.coalesce(F.sum(f"items_{o}"), F.lit(0)).alias(f"items_{o}_total") for o in ("new", "changed", "unchanged")], F.max("max_depth_reached").cast("long").alias("crawl_depth"))
    names = [c for c in wide.columns if c != "adapter"]
    return wide.select("adapter", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])))


def request_stats(log: DataFrame) -> DataFrame:
    """One row over a request log (host, status_code, bytes, retried, denied, skipped): counters and a map of statuses."""
    by_status = log.where("status_code is not null").groupBy("status_code").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("status_code").cast("string").alias("k"), "n")))).alias("by_status"))
    totals = log.agg(F.count("*").alias("requests"), F.count_if("retried").alias("retries"), F.count_if("denied").alias("robots_denied"), F.count_if("skipped").alias("circuit_skips"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_downloaded"))
    return totals.crossJoin(F.broadcast(by_status))  # one row each


def histogram(log: DataFrame, column: str, bounds: list[float], *keys: str) -> DataFrame:
    return bucket_counts(log, F.col(column), bounds, *keys)


def run_histograms(runs: DataFrame) -> DataFrame:
    """metric, adapter, le, n, count: how long runs took and how long they wrote, by the bounds of both."""
    wrote = runs.select("adapter", F.get_json_object("detail", "$.write_seconds").try_cast("double").alias("seconds")).where("seconds is not null")
    took = runs.select("adapter", F.col("duration_seconds").alias("seconds")).where("seconds is not null")
    named = lambda df, name, bounds: histogram(df, "seconds", bounds, "adapter").select(F.lit(name).alias("metric"), "adapter", "le", "n", "count")
    return named(took, "run_duration_seconds", DURATION).unionByName(named(wrote, "db_write_seconds", WRITE))


def wait_histogram(fetched: DataFrame, *keys: str) -> DataFrame:
    """How long pages waited for their host's tokens and backoff; fetched is what http.fetch() gives."""
    return histogram(fetched.where("waited is not null"), "waited", WAIT, *keys)


def exposition(samples: DataFrame, prefix: str = "listings") -> DataFrame:
    """Lines of the text format for samples (name, adapter, value)."""
    label = F.replace(F.replace("adapter", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return samples.select(F.format_string(f'{prefix}_%s{{adapter="%s"}} %s', F.col("name"), label, F.col("value").cast("string")).alias("line")).orderBy("line")
