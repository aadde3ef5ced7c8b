"""Schemas of the stored tables and of the records that flow between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
    "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(text: str) -> T.StructType:
    """Of "name type, ..."; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in text.split(", "))])


JOB_ITEMS = _schema(
    "id long, run_id long, source string, external_id string, url string, title string, company string, location string, remote boolean, "
    "employment_type string, salary_min double, salary_max double, salary_currency string, description string, tags array<string>, raw string, "
    "search_text string, posted_at timestamp, content_hash string, first_seen_at timestamp, last_seen_at timestamp, is_active boolean"
)
CRAWL_RUNS = _schema(
    "id long, adapter string, status string, started_at timestamp, finished_at timestamp, pages_fetched int, requests_made int, retries int, "
    "failures int, items_seen int, items_new int, items_changed int, items_unchanged int, max_depth_reached int, duration_seconds double, "
    "detail string, created_at timestamp"
)
RAW_PAGES = _schema(
    "id long, url string, status_code int, adapter string, kind string, content_hash string, size_bytes int, headers map<string,string>, "
    "body_gz binary, fetched_at timestamp, meta string"
)
FETCH_ERRORS = _schema("id long, run_id long, url string, error string, created_at timestamp")
#: A page as fetched or replayed.
PAGES = _schema(
    "url string, status_code int, text string, headers map<string,string>, content_hash string, fetched_at timestamp, from_snapshot boolean, kind string"
)
FOLLOWS = _schema("url string, kind string, depth int, meta string")
#: What a parser finds: plain fields and lists of texts.
RECORD = "struct<fields:map<string,string>,lists:map<string,array<string>>>"
#: An item before it is stored.
ITEM_COLUMNS = [
    "source", "external_id", "url", "title", "company", "location", "remote", "employment_type", "salary_min", "salary_max", "salary_currency",
    "description", "tags", "raw", "posted_at",
]
TABLES = {"job_items": JOB_ITEMS, "crawl_runs": CRAWL_RUNS, "raw_pages": RAW_PAGES, "fetch_errors": FETCH_ERRORS}
KEYS = {"job_items": ["source", "external_id"], "crawl_runs": ["id"], "raw_pages": ["id"], "fetch_errors": ["id"]}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of schema, in order; missing ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: a unique constraint's violations."""
    return df.groupBy(*keys).count().where("count > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose non-null key has no parent: a foreign key's violations."""
    parents = parent.select(F.col(parent_key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(parents, key, "left_anti")


def drift(df: DataFrame, schema: T.StructType) -> list[str]:
    """How df's columns differ from a schema, in words; empty if they don't."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in schema}
    return [f"missing {n}" for n in want if n not in have] + [f"extra {n}" for n in have if n not in want] + [f"{n} is {have[n].simpleString()}, not {want[n].simpleString()}" for n in want if n in have and have[n] != want[n]]
