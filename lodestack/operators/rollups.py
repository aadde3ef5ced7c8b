"""Counts and rollups over listings, runs and errors. Every "now" is an argument."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.errors import ConfigError
from lodestack.functions.display import share_display

FACETS = ("location", "employment_type", "source", "company")


def company_rollup(items: DataFrame, is_active: bool | None = True, limit: int = 100) -> DataFrame:
    """Per company: items, remote ones, latest posting, best salary. is_active=False means inactive only, None all."""
    df = items if is_active is None else items.where(F.col("is_active") == is_active)
    return (
        df.groupBy("company")
        .agg(F.count("*").alias("n_items"), F.count_if("remote").alias("n_remote"), F.max("posted_at").alias("latest_posted"), F.max("salary_max").alias("max_salary"))
        .orderBy(F.desc("n_items"), "company")
        .limit(limit)
    )


def value_counts(df: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """Values and how often, frequent first; nulls are not counted."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def facet(items: DataFrame, column: str, limit: int = 50) -> DataFrame:
    if column not in FACETS:
        raise ConfigError(f"no facet {column!r}")
    return value_counts(items.where("is_active"), column, limit)


def overview(items: DataFrame, as_of: datetime, recent_days: int = 7) -> DataFrame:
    """Totals over all items, inactive ones too, in one pass."""
    since = F.lit(as_of - timedelta(days=recent_days))
    return items.agg(
        F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if("remote").alias("remote"), F.count_if(F.col("salary_max").isNotNull()).alias("with_salary"), F.count_if(F.col("first_seen_at") >= since).alias("new_recent")
    )


def by_source(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def source_map(items: DataFrame) -> DataFrame:
    """by_source() as one map."""
    return by_source(items).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"))


def shares(totals: DataFrame) -> DataFrame:
    """Shares of an overview as text, of the active items."""
    return totals.select("*", share_display(F.col("remote"), F.col("active")).alias("remote_share"), share_display(F.col("with_salary"), F.col("active")).alias("salary_share"))


def daily_series(df: DataFrame, column: str, as_of: datetime, days: int = 30) -> DataFrame:
    """day, n for each of the days up to as_of. The first day counts from as_of's time of day on; later rows are cut."""
    since = as_of - timedelta(days=days - 1)
    counted = df.where((F.col(column) >= F.lit(since)) & F.col(column).isNotNull()).groupBy(F.to_date(column).alias("day")).agg(F.count("*").alias("_n"))
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(since.date()), F.lit(as_of.date()))).alias("day"))
    return spine.join(counted, "day", "left").select("day", F.coalesce("_n", F.lit(0)).alias("n")).orderBy("day")


def failure_breakdown(errors: DataFrame, run_id: int | None = None, limit: int = 20, column: str = "error") -> DataFrame:
    df = errors if run_id is None else errors.where(F.col("run_id") == run_id)
    return df.groupBy(F.col(column).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(limit)


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc_nulls_last(), F.col("id").desc()).limit(limit)


def latest_successful(runs: DataFrame) -> DataFrame:
    return recent_runs(runs.where("status = 'succeeded'"), 1)


def run_with_errors(runs: DataFrame, errors: DataFrame, run_id: int) -> DataFrame:
    """A run and its frequent errors as one row."""
    frequent = failure_breakdown(errors, run_id).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "error", "n"))).alias("e"))
    return runs.where(F.col("id") == run_id).crossJoin(F.broadcast(frequent.select(F.transform("e", lambda x: F.struct(x["error"].alias("error"), x["n"].alias("n"))).alias("errors"))))


def status_histogram(pages: DataFrame) -> DataFrame:
    return pages.groupBy("status_code").agg(F.count("*").alias("n"))


def bucket_counts(df: DataFrame, value: Column, bounds: list[float], *keys: str) -> DataFrame:
    """Cumulative histogram (le, n) with a last bucket +Inf, as monitoring systems read it; also sum and count."""
    flags = [F.count_if(value <= b).alias(f"b{k}") for k, b in enumerate(bounds)]
    wide = df.groupBy(*keys).agg(*flags, F.count(value).alias("count"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)]
    return wide.select(*keys, "count", "sum", F.inline(F.array(*rows, F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))))
