"""Content hashes and stable ids."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.arrow import row_by_row

#: What a listing's content is; its url, dates and raw fields are not.
CONTENT = ["title", "company", "location", "remote", "employment_type", "salary_min", "salary_max", "salary_currency", "description", "tags"]
_UNIT, _NULL = "\x1f", "\x00"


def content_hash(**columns: Column | str) -> Column:
    """SHA-256 over CONTENT as text, with nulls marked, units separated and tags sorted. JVM only."""
    parts = []
    for name in CONTENT:
        c = columns.get(name, F.col(name))
        c = F.col(c) if isinstance(c, str) else c
        if name == "tags":
            c = F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), "\x1e")
        elif name.startswith("salary_m"):
            c = F.round(c, 2).cast("decimal(20,2)").cast("string")
        else:
            c = c.cast("string")
        parts.append(F.coalesce(c, F.lit(_NULL)))
    return F.sha2(F.concat_ws(_UNIT, *parts), 256)


def stable_hash(values: dict) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces, ASCII."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def content_hash_compat(items: pd.DataFrame) -> pd.Series:
    """stable_hash() of CONTENT of a struct, byte for byte as canonical JSON gives it."""

    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return v.item() if hasattr(v, "item") and not hasattr(v, "__len__") else v

    def one(row) -> str:
        values = {c: plain(row[c]) for c in CONTENT if c != "tags"}
        values["remote"] = bool(values["remote"])
        for c in ("salary_min", "salary_max"):
            values[c] = None if values[c] is None else float(values[c])
        return stable_hash(values | {"tags": sorted(row["tags"] if row["tags"] is not None else [])})

    return pd.Series([one(row) for row in items.to_dict("records")], dtype=object)


#: Default external id: 12 bytes of BLAKE2b of the url, as hex.
url_id = row_by_row(lambda u: None if u is None else hashlib.blake2b(u.encode(), digest_size=12).hexdigest(), T.StringType(), pa.string())


def search_text(title: Column, company: Column, location: Column, employment_type: Column, tags: Column, description: Column) -> Column:
    """What search looks at: the non-empty parts, joined by spaces."""
    parts = [title, company, location, employment_type, F.array_join(tags, " "), description]
    return F.trim(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))


def item_key(source: Column, external_id: Column) -> Column:
    return F.concat_ws(":", source, external_id)


def page_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)
