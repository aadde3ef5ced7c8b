"""Listing queries: filters, search, sort and keyset pages, as predicates that reach the scan."""

from __future__ import annotations

import base64
import binascii
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.errors import ConfigError
from lodestack.functions.text import search_tokens

SORTS = {"posted_at": "timestamp", "first_seen_at": "timestamp", "last_seen_at": "timestamp", "company": "string"}
SUMMARY = [
    "id", "source", "title", "company", "location", "remote", "employment_type", "salary_min", "salary_max", "salary_currency", "tags", "posted_at",
    "first_seen_at", "last_seen_at", "is_active",
]
DETAIL = [*SUMMARY, "description", "url", "external_id", "content_hash", "run_id", "raw"]
RUN_SUMMARY = [
    "id", "adapter", "status", "started_at", "finished_at", "pages_fetched", "requests_made", "retries", "failures", "items_seen", "items_new", "items_changed",
    "items_unchanged", "max_depth_reached", "duration_seconds",
]
RUN_DETAIL = [*RUN_SUMMARY, "detail"]


def search(query: str, text: Column, title: Column | None = None, mode: str = "simple") -> Column:
    """simple: every token of the query occurs; substring: text or title contains it in any case."""
    if mode == "simple":
        return search_indexed(query, search_tokens(text))
    if mode != "substring":
        raise ConfigError(f"no search mode {mode!r}")
    pattern = f"%{query.strip()}%"
    found = text.ilike(pattern)
    return found if title is None else found | title.ilike(pattern)


def search_indexed(query: str, tokens: Column) -> Column:
    """search() in simple mode over a token array, which is made once a row."""
    wanted = search_tokens(F.lit(query))
    return (F.size(F.array_except(wanted, tokens)) == 0) & (F.size(wanted) > 0)


@dataclass(frozen=True)
class ItemFilters:
    """What to list. None means no condition; so does is_active=False."""

    is_active: bool | None = True
    companies: tuple[str, ...] = ()
    location: str | None = None
    remote: bool | None = None
    employment_type: str | None = None
    source: str | None = None
    posted_after: datetime | None = None
    has_salary: bool | None = None
    min_salary: float | None = None
    q: str | None = None
    q_mode: str = "simple"
    sort: str = "posted_at"
    descending: bool = True
    limit: int = 50
    cursor: str | None = None
    null_safe: bool = True

    def __post_init__(self):
        if self.sort not in SORTS:
            raise ConfigError(f"cannot sort by {self.sort!r}")
        if not 1 <= self.limit <= 200:
            raise ConfigError("limit must be from 1 to 200")
        if self.min_salary is not None and self.min_salary < 0:
            raise ConfigError("min_salary must not be negative")

    def predicate(self) -> Column:
        """All conditions but the cursor."""
        c = F.col
        parts = [c("is_active")] if self.is_active else []
        if self.companies:
            parts.append(c("company").isin(*self.companies))
        if self.location:
            parts.append(c("location").ilike(f"%{self.location}%"))
        if self.remote is not None:
            parts.append(c("remote") == self.remote)
        if self.employment_type:
            parts.append(c("employment_type") == self.employment_type)
        if self.source:
            parts.append(c("source") == self.source)
        if self.posted_after:
            parts.append(c("posted_at") >= F.lit(self.posted_after))
        if self.has_salary is not None:
            parts.append(c("salary_max").isNotNull() if self.has_salary else c("salary_max").isNull())
        if self.min_salary is not None:
            parts.append((c("salary_max") >= self.min_salary) | (c("salary_min") >= self.min_salary))
        if self.q:
            parts.append(search(self.q, c("search_text"), c("title"), self.q_mode))
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out


def encode_cursor(value: object, row_id: int) -> str:
    """An opaque text for a sort value and an id."""
    if isinstance(value, datetime):
        value = (value if value.tzinfo else value.replace(tzinfo=UTC)).astimezone(UTC).isoformat()
    return base64.urlsafe_b64encode(f"{'' if value is None else value}|{row_id}".encode()).decode().rstrip("=")


def cursor_column(value: Column, row_id: Column) -> Column:
    """encode_cursor() of text values as a column."""
    raw = F.base64(F.encode(F.concat(F.coalesce(value, F.lit("")), F.lit("|"), row_id.cast("string")), "UTF-8"))
    return F.regexp_replace(F.translate(raw, "+/", "-_"), "=+$", "")


def decode_cursor(cursor: str, sort: str = "posted_at") -> tuple[object, int] | None:
    """Sort value, typed by its column, and id; None if malformed."""
    try:
        raw = base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True).decode()
        value, mark, row_id = raw.rpartition("|")
        if not mark:
            return None
        if value and SORTS.get(sort) == "timestamp":
            return datetime.fromisoformat(value), int(row_id)
        return value or None, int(row_id)
    except (ValueError, binascii.Error):
        return None


def after_cursor(sort: str, value: object, row_id: int, descending: bool = True, null_safe: bool = True, key: str = "id") -> Column:
    """Rows after a cursor in the order of sort, ids falling. Nulls sort last.

    null_safe=False gives the plain predicate: a null cursor looks at ids only and a cursor with a
    value never meets rows without one.
    """
    c, by_id = F.col(sort), F.col(key) < row_id
    if value is None:
        return (c.isNull() & by_id) if null_safe else by_id
    v = F.lit(value)
    later = ((c < v) if descending else (c > v)) | ((c == v) & by_id)
    return later | c.isNull() if null_safe else later


def ordered(df: DataFrame, sort: str, descending: bool = True, key: str = "id") -> DataFrame:
    return df.orderBy(F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last(), F.col(key).desc())


def list_items(items: DataFrame, f: ItemFilters) -> DataFrame:
    """The rows of one page and one more, which tells whether there is a next page."""
    df = items.where(f.predicate())
    at = decode_cursor(f.cursor, f.sort) if f.cursor else None
    if at:
        df = df.where(after_cursor(f.sort, at[0], at[1], f.descending, f.null_safe))
    return ordered(df, f.sort, f.descending).limit(f.limit + 1)


def page(items: DataFrame, f: ItemFilters, columns: list[str] | None = None) -> tuple[list, str | None]:
    """A page's rows (limit at most) and the cursor of the next one."""
    names = columns or SUMMARY
    rows = list_items(items, f).select(*dict.fromkeys([*names, f.sort, "id"])).collect()  # 201 rows at most
    more = len(rows) > f.limit
    rows = rows[: f.limit]
    return rows, encode_cursor(rows[-1][f.sort], rows[-1]["id"]) if more else None


def by_id(items: DataFrame, row_id: int, columns: list[str] | None = None) -> DataFrame:
    return items.where(F.col("id") == row_id).select(*(columns or DETAIL)).limit(1)


def with_tokens(items: DataFrame) -> DataFrame:
    """items with the stored token array that search_indexed() reads."""
    return items.withColumn("tokens", F.array_distinct(search_tokens(F.col("search_text"))))


def inverted_index(items: DataFrame) -> DataFrame:
    """token, id: for point lookups of rare words, to be written sorted by token."""
    return items.select(F.explode(F.array_distinct(search_tokens(F.col("search_text")))).alias("token"), "id")
