"""URL functions: columns where the JVM can do it, urllib behind Arrow where it cannot."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPLIT = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _SPLIT, k)


def join_url(base: str | None, href: str | None) -> str | None:
    """href as seen from base, if it leads to a web page."""
    link = (href or "").strip()
    if not link or link.startswith(("#", "javascript:", "mailto:", "tel:")):
        return None
    try:
        found = urljoin(base or "", link)
        return found if urlsplit(found).scheme in ("http", "https") else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def absolute_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([join_url(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def canonical_url(url: Column) -> Column:
    """Scheme and host lowered, fragment dropped, query parts sorted; the path stays."""
    text = F.trim(url)
    parts = F.filter(F.split(F.substring(_part(text, 4), 2, 1 << 30), "&"), lambda p: p != "")
    query = F.array_join(F.array_sort(parts), "&")
    return F.concat(F.lower(_part(text, 1)), F.lower(_part(text, 2)), _part(text, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def hostname(url: Column) -> Column:
    """Lower-cased host without user and port; empty if there is none."""
    place = F.regexp_replace(F.substring(_part(url, 2), 3, 1 << 30), r"^.*@", "")
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_replace(place, r":\d*$", ""), r"^\[|\]$", "")), F.lit(""))


def host_of(url: Column) -> Column:
    """The host as a key for politeness: with its port unless 80 or 443; without a host, the url itself."""
    port = F.regexp_extract(_part(url, 2), r":(\d+)$", 1).try_cast("int")
    host = hostname(url)
    return F.when(host == "", F.lower(url)).when(port.isNotNull() & ~port.isin(0, 80, 443), F.concat_ws(":", host, port.cast("string"))).otherwise(host)


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts but for www., or one a subdomain of the other."""
    x, y = (F.regexp_replace(hostname(u), r"^www\.", "") for u in (a, b))
    return (x != "") & (y != "") & ((x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x)))


def robots_url(url: Column) -> Column:
    return F.concat(_part(url, 1), _part(url, 2), F.lit("/robots.txt"))


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def redact_credentials(url: Column) -> Column:
    """User and password of a database url become ***."""
    return F.regexp_replace(url, r"://[^/@]*@", "://***@")


def template_url(base: str, template: str, page: int) -> str:
    return urljoin(base, template.format(page=page))


def with_query_param(url: str, name: str, value: object) -> str:
    parts = urlsplit(url)
    query = dict(parse_qsl(parts.query, keep_blank_values=True)) | {name: str(value)}
    return urlunsplit(parts._replace(query=urlencode(query)))
