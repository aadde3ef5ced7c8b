"""The page archive: append, latest by url, listing, pruning."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestack.errors import ConfigError
from lodestack.functions.hashing import page_hash
from lodestack.schemas import PAGES, RAW_PAGES, conform

MOST_BYTES = 4 * 1024 * 1024


@F.pandas_udf(T.BinaryType())
def compress(texts: pd.Series) -> pd.Series:
    """gzip, the same bytes for the same text."""
    return texts.map(lambda t: None if t is None else gzip.compress(t.encode(), compresslevel=6, mtime=0))


@F.pandas_udf(T.StringType())
def decompress(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: None if b is None else gzip.decompress(b).decode("utf-8", "replace"))


def build_pages(raw: DataFrame) -> DataFrame:
    """Pages of rows (url, status_code, text, headers, fetched_at, kind): header names lowered, body hashed."""
    lowered = F.map_from_entries(F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    have = set(raw.columns)
    df = raw.withColumn("headers", lowered) if "headers" in have else raw
    df = df.withColumn("content_hash", page_hash(F.col("text")))
    if "from_snapshot" not in have:
        df = df.withColumn("from_snapshot", F.lit(False))
    return conform(df, PAGES)


def is_html(headers: Column) -> Column:
    """By content type; none counts as html."""
    kind = F.coalesce(headers["content-type"], F.lit(""))
    return (kind == "") | F.lower(kind).contains("html")


def archive_rows(pages: DataFrame, adapter: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows for the archive, without ids: bodies within the limit, cookies left out."""
    df = pages.withColumn("size_bytes", F.octet_length("text")).where(F.col("size_bytes") <= most_bytes)
    headers = F.map_filter("headers", lambda k, _: F.lower(k) != "set-cookie")
    return conform(df.withColumns({"adapter": F.lit(adapter), "headers": headers, "body_gz": compress("text")}), RAW_PAGES)


def too_large(pages: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Pages that archive_rows() leaves out."""
    return pages.where(F.octet_length("text") > most_bytes)


def latest(archive: DataFrame, url: str = "url", at: str = "fetched_at", key: str = "id") -> DataFrame:
    """The newest row of each url, one aggregation without a sort of the archive."""
    newest = archive.groupBy(url).agg(F.max_by(F.struct(*[c for c in archive.columns if c != url]), F.struct(at, key)).alias("_r"))
    return newest.select(url, "_r.*").select(*archive.columns)


def urls(archive: DataFrame, adapter: str | None = None, limit: int = 5000) -> DataFrame:
    """url, last_fetched_at: each url once, recent ones first."""
    df = archive if adapter is None else archive.where(F.col("adapter") == adapter)
    return df.groupBy("url").agg(F.max("fetched_at").alias("last_fetched_at")).orderBy(F.col("last_fetched_at").desc_nulls_last(), "url").limit(limit)


def prune(archive: DataFrame, keep_per_url: int = 1, url: str = "url", at: str = "fetched_at", key: str = "id") -> DataFrame:
    """The archive with the newest rows of each url only."""
    if keep_per_url < 1:
        raise ConfigError("keep at least one row per url")
    by = Window.partitionBy(url).orderBy(F.col(at).desc(), F.col(key).desc())
    return archive.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= keep_per_url).drop("_n")


def replayed(archive: DataFrame) -> DataFrame:
    """Archive rows as pages."""
    return archive.select("url", "status_code", decompress("body_gz").alias("text"), "headers", "content_hash", "fetched_at", F.lit(True).alias("from_snapshot"), "kind", "meta")
