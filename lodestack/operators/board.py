"""From board pages to items: extraction by selectors in one Arrow UDF, everything after that in columns."""

from __future__ import annotations

import html
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions import hashing, text
from lodestack.functions.arrow import row_by_row
from lodestack.functions.markup import Node, Selector, parse, squeeze
from lodestack.functions.urls import join_url
from lodestack.schemas import ITEM_COLUMNS, RECORD
from lodestack.session import spread
from lodestack.sources.board_config import BoardConfig

PAGE_RESULT = f"struct<details:array<struct<url:string,seed:{RECORD}>>,next:string,record:{RECORD},error:string>"
_RECORD = pa.struct([("fields", pa.map_(pa.string(), pa.string())), ("lists", pa.map_(pa.string(), pa.list_(pa.string())))])
_RESULT = pa.struct([("details", pa.list_(pa.struct([("url", pa.string()), ("seed", _RECORD)]))), ("next", pa.string()), ("record", _RECORD), ("error", pa.string())])
_SCRIPTS = re.compile(r"<(script|style)\b.*?</\1>", re.I | re.S)


def _clean(value: str) -> str:
    return squeeze(html.unescape(_SCRIPTS.sub(" ", value)))


def _record(root: Node, spec) -> dict:
    """The fields of a list or detail description, as RECORD."""
    found: dict = {"fields": {}, "lists": {}}
    cut = re.compile("|".join(map(re.escape, spec.tag_separators))) if spec.tag_separators else None
    for name, raw in spec.fields.items():
        selector = Selector.parse(raw)
        if name in spec.multi_fields:
            parts = [p for v in selector.all(root) for p in (cut.split(v) if cut else [v])]
            if parts := [c for p in parts if (c := _clean(p))]:
                found["lists"][name] = parts
        elif (value := selector.first(root)) is not None:
            found["fields"][name] = value
    return found


def list_page(markup: str | None, base: str | None, config: BoardConfig) -> dict:
    """Detail links with what the list says about each, and the link to the next page."""
    root, details = parse(markup), {}
    link = Selector.parse(config.list.url)
    for card in root.select(config.list.item_selector):
        url = join_url(base, link.first(card))
        if url and url not in details:
            seed = _record(card, config.list)
            if config.list.external_id and (own := Selector.parse(config.list.external_id).first(card)):
                seed["fields"].setdefault("external_id", own)
            details[url] = seed
    following = None
    if config.pagination.next_selector:
        links = (join_url(base, n.attrs.get("href")) for n in root.select(config.pagination.next_selector))
        following = next((u for u in links if u and u not in details), None)
    return {"details": [{"url": u, "seed": s} for u, s in details.items()], "next": following}


def detail_page(markup: str | None, config: BoardConfig) -> dict:
    """What a detail page says, as RECORD; its description is markup."""
    if not config.detail:
        return {"fields": {}, "lists": {}}
    root = parse(markup)
    for n in root.select(config.detail.remove) if config.detail.remove else []:
        n.remove()
    found = _record(root, config.detail)
    if "description" in config.detail.fields:
        block = root.select(Selector.parse(config.detail.fields["description"]).css)
        if block:
            found["fields"]["description"] = block[0].html()
    return found


def parse_page(kind: str, markup: str | None, base: str | None, config: BoardConfig) -> dict:
    """PAGE_RESULT of a page; whatever a page makes the parser raise is its error and nobody else's."""
    out: dict = {"details": [], "next": None, "record": {"fields": {}, "lists": {}}, "error": None}
    try:
        if kind == "list":
            out |= list_page(markup, base, config)
        elif kind == "detail":
            out["record"] = detail_page(markup, config)
    except Exception as e:  # noqa: BLE001
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def parse_pages(kind: Column, markup: Column, base: Column, config: BoardConfig) -> Column:
    """PAGE_RESULT of index pages (kind list) and detail pages (kind detail); other kinds hold nothing.

    Marked as not deterministic, so that no filter on what was found is pushed below it, which would parse every page again.
    """
    return row_by_row(lambda k, p, b: parse_page(k, p, b, config), PAGE_RESULT, _RESULT, large=True).asNondeterministic()(kind, markup, base)


def next_links(markup: Column, base: Column, config: BoardConfig) -> Column:
    """The link to the next page, if the page is read as an index page; null where there is none or the parser fails."""
    return row_by_row(lambda p, b: parse_page("list", p, b, config)["next"], "string", pa.string(), large=True).asNondeterministic()(markup, base)


def overlay(seed: Column, over: Column) -> Column:
    """Two maps as one; the second wins."""
    none = F.create_map().cast("map<string,string>")
    seed, over = F.coalesce(seed, none), F.coalesce(over, none)
    return F.map_concat(F.map_filter(seed, lambda k, _: ~F.map_contains_key(over, k)), over)


def overlay_lists(seed: Column, over: Column) -> Column:
    none = F.create_map().cast("map<string,array<string>>")
    seed, over = F.coalesce(seed, none), F.coalesce(over, none)
    return F.map_concat(F.map_filter(seed, lambda k, _: ~F.map_contains_key(over, k)), over)


def _as_json(fields: list | None, lists: list | None) -> str:
    """All that was extracted but the description, as JSON."""
    values = {k: v for k, v in fields or [] if k != "description"} | dict(lists or [])
    return json.dumps(values, ensure_ascii=False, sort_keys=True)


_raw_json = row_by_row(_as_json, T.StringType(), pa.string())


def build_items(records: DataFrame, config: BoardConfig) -> DataFrame:
    """Items of rows (url, fields, lists). Rows without a title or a company are not listings and go."""
    get = lambda name: F.col("fields")[name]
    text_of = lambda name: text.normalise_text(get(name))
    nothing = F.lit(None).cast("string")
    df = records.select("url", "fields", "lists", text_of("title").alias("title"), text_of("company").alias("company"), F.nullif(text_of("location"), F.lit("")).alias("location"))
    df = df.where("title <> '' and company <> ''")
    body = F.when(F.coalesce(get("description"), F.lit("")) != "", text.html_to_text(get("description"))).otherwise(text_of("summary"))
    df = df.withColumn("description", text.truncate(text.scrub_pii(body)))
    pay = F.concat_ws(" ", *[F.nullif(get(n), F.lit("")) for n in ("salary", "salary_min", "salary_max")])
    df = df.withColumn("_pay", text.parse_salary(F.nullif(pay, F.lit(""))))
    own_type = F.nullif(text_of("employment_type"), F.lit(""))
    guessed = text.detect_employment_type(F.col("title"), F.col("description")) if config.infer_employment_type else nothing
    df = df.withColumn("_type", own_type).withColumn("employment_type", F.when(F.col("_type").isNotNull(), F.coalesce(text.detect_employment_type(F.col("_type")), F.col("_type"))).otherwise(guessed))
    remote = F.coalesce(get("remote"), F.lit("")) != ""
    if config.infer_remote:
        remote = remote | text.looks_remote(F.col("location"), F.col("title"), F.col("description"))
    df = df.withColumn("remote", remote)
    tags = text.with_remote_tag(F.transform(F.coalesce(F.col("lists")["tags"], F.array().cast("array<string>")), text.normalise_ws), F.col("remote"))
    explicit = F.substring(F.nullif(get("external_id"), F.lit("")), 1, 255)
    return df.select(
        F.lit(config.name).alias("source"),
        F.coalesce(explicit, hashing.url_id(F.col("url"))).alias("external_id"),
        "url", "title", "company", "location", "remote", "employment_type",
        F.col("_pay.min").alias("salary_min"), F.col("_pay.max").alias("salary_max"), F.col("_pay.currency").alias("salary_currency"),
        "description",
        text.clean_tags(tags).alias("tags"),
        _raw_json(F.col("fields"), F.col("lists")).alias("raw"),
        text.parse_date(get("posted_at")).alias("posted_at"),
    ).select(*ITEM_COLUMNS)


def details_of(pages: DataFrame, config: BoardConfig) -> DataFrame:
    """Records (url, fields, lists) of detail pages (url, text) that no list told of."""
    found = spread(pages.select("url", "text")).select("url", parse_pages(F.lit("detail"), F.col("text"), F.col("url"), config)["record"].alias("r"))
    return found.select("url", "r.fields", "r.lists")
