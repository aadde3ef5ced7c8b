"""From discussion threads (JSON documents) to items: three stages of from_json and explode, and one fold.

The fold over a comment's first lines depends on what came before, line by line, so it is a Python
function behind Arrow; it returns raw parts, and salaries, dates, tags and redaction are columns.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text
from lodestack.functions.arrow import row_by_row
from lodestack.functions.markup import parse, squeeze
from lodestack.schemas import ITEM_COLUMNS

SEARCH = "hits array<struct<objectID:string,title:string,created_at_i:bigint,created_at:string>>"
THREAD = "id bigint, time bigint, kids array<bigint>"
COMMENT = "id bigint, parent_id bigint, text string, kids array<bigint>, deleted boolean, dead boolean"

# How a posting is recognised.
ROLE_LINE = re.compile(r"([^|]{2,80})\s*\|\s*(.+)")
META_LINE = re.compile(
    r"(?:(?:location|based in|office|locations?)\s*[:\-]\s*.+|remote|fully remote|hybrid|on-?site|worldwide|anywhere|"
    r"full[- ]?time|part[- ]?time|contract(?:or)?|intern(?:ship)?|temporary)\s*",
    re.I,
)
SALARY_LINE = re.compile(r"(?:salary|comp(?:ensation)?|pay|rate|budget)\s*[:\-]?\s*([^|]{1,80})", re.I)
LOCATION_PREFIX = re.compile(r"(?:location|based in|office|locations?)\s*[:\-]\s*", re.I)
REMOTE_MARKERS = {"remote", "fully remote", "work from home", "wfh", "distributed", "anywhere", "worldwide"}
HEAD_LINES, META_LINES, LABEL_CHARS = 6, 4, 24

PARTS = "struct<company:string,role:string,location:string,remote:boolean,employment_type:string,salary_text:string,body:string,links:array<string>,readable:string>"
_ARROW = pa.struct([(f, {"remote": pa.bool_(), "links": pa.list_(pa.string())}.get(f, pa.string())) for f in ("company", "role", "location", "remote", "employment_type", "salary_text", "body", "links", "readable")])
_INTERN = re.compile(text.INTERNSHIP, re.I)


def _label(segment: str) -> str | None:
    low = segment.lower()
    found = next((label for needle, label in text.EMPLOYMENT_TYPES.items() if needle in low), None)
    return found or ("internship" if _INTERN.search(low) else None)


def links_of(root, markup: str) -> list[str]:
    """Absolute links without query, first occurrences; bare urls if no element has one."""
    hrefs = [n.attrs["href"] for n in root.select("a[href]") if n.attrs["href"].startswith(("http://", "https://"))]
    return list(dict.fromkeys(u.split("?")[0] for u in hrefs or re.findall(r"https?://[^\s<>\"']+", markup)))


def fold_comment(markup: str | None, readable: str | None) -> dict | None:
    """The parts of a comment that is a posting; readable is its text by html_to_text()."""
    lines = [c for line in (readable or "").split("\n") if (c := squeeze(html.unescape(line)))]
    head = next(((k, m) for k, line in enumerate(lines[:HEAD_LINES]) if (m := ROLE_LINE.fullmatch(line))), None)
    if head is None:
        return None
    start, (company, role) = head[0] + 1, (squeeze(g) for g in head[1].groups())
    if not company or not role:
        return None
    location = kind = pay = None
    remote, at = False, start
    for line in lines[start : start + META_LINES]:
        if META_LINE.fullmatch(line):
            for part in line.split("|"):
                value = squeeze(LOCATION_PREFIX.sub("", part.strip(), count=1) if LOCATION_PREFIX.match(part.strip()) else part)
                if not value:
                    continue
                if value.lower() in REMOTE_MARKERS:
                    remote = True
                elif len(value) <= LABEL_CHARS and (label := _label(value)):
                    kind = label
                elif location is None:
                    location = value
        elif pay is None and (m := SALARY_LINE.match(line)):
            pay = squeeze(m[1])
        else:
            break
        at += 1
    root = parse(markup)
    quoted = [t for n in root.select("i") if (t := squeeze(n.text()))]
    return {
        "company": company, "role": role, "location": location, "remote": remote, "employment_type": kind, "salary_text": pay,
        "body": "\n".join(quoted or lines[at:]), "links": links_of(root, markup or ""),
    }


def _parts(markup: str | None, stripped: str) -> dict:
    readable = text.lines_of(stripped)
    return (fold_comment(markup, readable) or {}) | {"readable": readable}


def _fold(markup: Column) -> Column:
    """PARTS of comments, with the text of html_to_text() as readable: one worker makes both.

    Marked as not deterministic, so that a filter on what was found does not make it again.
    """
    return row_by_row(_parts, PARTS, _ARROW, large=True).asNondeterministic()(markup, text.strip_tags(markup))


def parse_comments(comments: DataFrame, markup: str = "text", only_postings: bool = False) -> DataFrame:
    """comments with a column posting (null where a comment is none, or without these comments).

    They are left out before anything is derived from them: a filter on posting itself would be
    pushed below all that makes it, with every expression written out.
    """
    df = comments.withColumn("_f", _fold(F.col(markup)))
    df = df.withColumn("_readable", F.col("_f.readable"))
    is_one = F.col("_f.company").isNotNull() & (F.col("_readable") != "") & text.is_posting(F.col("_readable"))
    df = df.withColumn("_is_one", is_one)
    if only_postings:
        df = df.where("_is_one")
    df = df.withColumn("_body", text.truncate(text.scrub_pii(F.col("_f.body"))))
    role, location, body = F.col("_f.role"), F.coalesce("_f.location", F.lit("")), F.col("_body")
    df = df.withColumn("_role", role).withColumn("_whole", F.concat_ws(" ", role, location, body))
    role, whole = F.col("_role"), F.col("_whole")
    df = df.withColumn("_paytext", F.coalesce(F.nullif("_f.salary_text", F.lit("")), whole)).withColumn("_remote", F.coalesce("_f.remote", F.lit(False)) | text.looks_remote(whole))
    kind = F.coalesce("_f.employment_type", text.detect_employment_type(role, body))
    pay = text.parse_salary(F.col("_paytext"))
    df = df.withColumn("_kind", kind).withColumn("_pay", pay)
    labels = F.filter(F.array(F.when(F.col("_remote"), "remote"), F.col("_kind")), lambda t: t.isNotNull())
    posting = F.struct(
        F.col("_f.company").alias("company"), role.alias("role"), F.col("_f.location").alias("location"), F.col("_remote").alias("remote"), F.col("_kind").alias("employment_type"),
        F.col("_pay.min").alias("salary_min"), F.col("_pay.max").alias("salary_max"), F.col("_pay.currency").alias("salary_currency"),
        body.alias("description"), F.col("_f.links").alias("links"), F.concat(labels, text.tech_tags(body)).alias("tags"),
    )
    return df.withColumn("posting", posting if only_postings else F.when(F.col("_is_one"), posting)).drop("_is_one", "_readable", "_f", "_body", "_remote", "_kind", "_pay", "_role", "_whole", "_paytext")


def to_items(postings: DataFrame, source: str, web: str) -> DataFrame:
    """Items of rows (comment_id, thread_id, posted_at, posting), none of them null; web is the page url with {id}."""
    page = F.replace(F.lit(web), F.lit("{id}"), F.col("comment_id").cast("string"))
    more = F.slice("posting.links", 2, 1 << 20)
    body = F.when(F.size("posting.links") > 1, F.concat(F.col("posting.description"), F.lit("\n\nLinks:\n"), F.array_join(more, "\n"))).otherwise(F.col("posting.description"))
    raw = F.to_json(F.struct("comment_id", "thread_id", F.col("posting.links").alias("links"), page.alias("page")))
    return postings.select(
        F.lit(source).alias("source"), F.col("comment_id").cast("string").alias("external_id"), F.coalesce(F.try_element_at("posting.links", F.lit(1)), page).alias("url"),
        text.normalise_ws(F.col("posting.role")).alias("title"), text.normalise_ws(F.col("posting.company")).alias("company"), "posting.location", "posting.remote", "posting.employment_type",
        "posting.salary_min", "posting.salary_max", "posting.salary_currency", text.truncate(text.scrub_pii(body)).alias("description"),
        text.clean_tags(F.col("posting.tags")).alias("tags"), raw.alias("raw"), "posted_at",
    ).select(*ITEM_COLUMNS)


def _document(body: Column, schema: str) -> Column:
    """A JSON object; anything else is null."""
    return F.when(F.ltrim(body).startswith("{"), F.from_json(body, schema))


def search_stage(pages: DataFrame, item_base: str, threads: int = 2, include_seekers: bool = True) -> DataFrame:
    """Threads to follow (url, thread_id, title, posted_at) of search results (text), the first ones of each page."""
    hit = F.col("hit")
    wanted = text.is_hiring_thread(hit["title"])
    if not include_seekers:
        wanted = wanted & F.lower(hit["title"]).contains("who is hiring")
    hits = pages.select(F.col("url").alias("_page"), F.filter(_document(F.col("text"), SEARCH)["hits"], lambda h: text.is_hiring_thread(h["title"])).alias("hits"))
    each = hits.select("_page", F.posexplode("hits").alias("pos", "hit")).where(wanted)
    if include_seekers:
        each = each.where(F.col("pos") < threads)
    else:
        from pyspark.sql.window import Window

        each = each.withColumn("pos", F.row_number().over(Window.partitionBy("_page").orderBy("pos")) - 1).where(F.col("pos") < threads)
    each = each.where(hit["objectID"].isNotNull())
    posted = text.posted_from_epoch(hit["created_at_i"], hit["created_at"])
    return each.select(F.concat(F.lit(item_base + "/"), hit["objectID"], F.lit(".json")).alias("url"), hit["objectID"].try_cast("long").alias("thread_id"), hit["title"].alias("title"), posted.alias("posted_at"), "pos")


def thread_stage(pages: DataFrame, item_base: str, most: int = 400) -> DataFrame:
    """Comments to follow (url, comment_id, thread_id, posted_at, depth) of threads (text, thread_id, posted_at)."""
    doc = _document(F.col("text"), THREAD)
    df = pages.select(doc.alias("d"), F.col("thread_id"), F.col("posted_at"))
    return df.select(F.coalesce("thread_id", "d.id").alias("thread_id"), F.coalesce(F.timestamp_seconds("d.time"), F.col("posted_at")).alias("posted_at"), F.posexplode(F.slice("d.kids", 1, most)).alias("pos", "comment_id")).select(
        F.concat(F.lit(item_base + "/"), F.col("comment_id").cast("string"), F.lit(".json")).alias("url"), "comment_id", "thread_id", "posted_at", F.lit(1).alias("depth"), "pos"
    )


def comment_stage(pages: DataFrame, source: str, web: str) -> DataFrame:
    """Items of comments (text, thread_id, posted_at); deleted and dead ones go."""
    df = pages.select(_document(F.col("text"), COMMENT).alias("d"), "thread_id", "posted_at").where("d is not null and not coalesce(d.deleted, false) and not coalesce(d.dead, false)")
    df = df.select(F.col("d.id").alias("comment_id"), F.coalesce("thread_id", "d.parent_id").alias("thread_id"), "posted_at", F.col("d.text").alias("text"))
    return to_items(parse_comments(df, only_postings=True), source, web)


def reply_stage(pages: DataFrame, item_base: str, most: int = 400) -> DataFrame:
    """Replies to follow of comments (text, thread_id, depth) above depth 2."""
    df = pages.where("depth < 2").select(_document(F.col("text"), COMMENT).alias("d"), "thread_id", "depth").where("d is not null and not coalesce(d.deleted, false) and not coalesce(d.dead, false)")
    return df.select("thread_id", "depth", F.posexplode(F.slice("d.kids", 1, most)).alias("pos", "comment_id")).select(
        F.concat(F.lit(item_base + "/"), F.col("comment_id").cast("string"), F.lit(".json")).alias("url"), "comment_id", "thread_id", F.lit(None).cast("timestamp").alias("posted_at"), (F.col("depth") + 1).alias("depth"), "pos"
    )
