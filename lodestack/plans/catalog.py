"""The library's operators over the driver's tables, each with its SQL twin where SQL can say it.

Tables stand for what the operators are made for: orders are listings, lineitem is the page
archive, events are runs and errors, pages are page bodies, documents are free text.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import display, hashing, markup, text, urls
from lodestack.operators import filters, frontier, merge, metrics, policy, rollups, thread
from lodestack.session import spread
from lodestack.sources import archive

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AS_OF = datetime(2024, 1, 30, 12)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, source: str, sql: str | None = None):
    """Register a query that maps one table to a result."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(table(spark, sf_dir, source))
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def listings(orders: DataFrame) -> DataFrame:
    """orders in the shape of listings."""
    c = F.col
    return orders.select(
        c("o_orderkey").alias("id"), c("o_orderstatus").alias("source"), c("o_orderkey").cast("string").alias("external_id"), c("o_custkey").cast("string").alias("company"),
        c("o_orderpriority").alias("employment_type"), c("o_orderpriority").alias("location"), (c("o_orderpriority") == "1-URGENT").alias("remote"), (c("o_orderstatus") != "F").alias("is_active"),
        F.when(c("o_orderkey") % 3 == 0, c("o_totalprice") / 2).alias("salary_min"), F.when(c("o_orderkey") % 5 != 0, c("o_totalprice")).alias("salary_max"),
        F.when(c("o_orderkey") % 7 != 0, c("o_orderdate")).alias("posted_at"), c("o_orderdate").alias("first_seen_at"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("search_text"), c("o_orderpriority").alias("title"),
    )


LISTINGS = """(SELECT o_orderkey AS id, o_orderstatus AS source, CAST(o_orderkey AS VARCHAR) AS external_id, CAST(o_custkey AS VARCHAR) AS company,
    o_orderpriority AS employment_type, o_orderpriority AS location, o_orderpriority = '1-URGENT' AS remote, o_orderstatus <> 'F' AS is_active,
    CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2 END AS salary_min, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS salary_max,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS posted_at, o_orderdate AS first_seen_at,
    o_orderpriority || ' ' || o_orderstatus AS search_text, o_orderpriority AS title FROM orders)"""


# rollups -------------------------------------------------------------------------------------


@query("company_rollup", "orders", f"""SELECT company, count(*) AS n_items, CAST(count(*) FILTER (remote) AS BIGINT) AS n_remote, max(posted_at) AS latest_posted, max(salary_max) AS max_salary
    FROM {LISTINGS} WHERE is_active GROUP BY company ORDER BY n_items DESC, company LIMIT 100""")
def _(t):
    return rollups.company_rollup(listings(t))


@query("company_rollup_all", "orders", f"""SELECT company, count(*) AS n_items, CAST(count(*) FILTER (remote) AS BIGINT) AS n_remote, max(posted_at) AS latest_posted, max(salary_max) AS max_salary
    FROM {LISTINGS} GROUP BY company ORDER BY n_items DESC, company LIMIT 100""")
def _(t):
    return rollups.company_rollup(listings(t), is_active=None)


@query("company_rollup_inactive", "orders", f"""SELECT company, count(*) AS n_items, CAST(count(*) FILTER (remote) AS BIGINT) AS n_remote, max(posted_at) AS latest_posted, max(salary_max) AS max_salary
    FROM {LISTINGS} WHERE NOT is_active GROUP BY company ORDER BY n_items DESC, company LIMIT 100""")
def _(t):
    return rollups.company_rollup(listings(t), is_active=False)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("company"), "c_name")
    return rollups.company_rollup(listings(table(spark, sf_dir, "orders"))).join(names, "company")


QUERIES["company_rollup_named"] = _named
ORACLE["company_rollup_named"] = f"""SELECT r.*, c_name FROM ({ORACLE["company_rollup"]}) r JOIN customer ON CAST(c_custkey AS VARCHAR) = company"""

for _column in ("employment_type", "source", "location", "company"):
    query(f"facet_{_column}", "orders", f"SELECT {_column} AS value, count(*) AS n FROM {LISTINGS} WHERE is_active AND {_column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 50")(lambda t, c=_column: rollups.facet(listings(t), c))

query("facet_lang", "documents", "SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")(lambda t: rollups.value_counts(t, "lang"))
query("facet_document_source", "documents", "SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 50")(lambda t: rollups.value_counts(t, "source"))

_OVERVIEW = f"""SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (remote) AS remote, count(salary_max) AS with_salary,
    count(*) FILTER (first_seen_at >= TIMESTAMP '2001-01-01 00:00:00') AS new_recent FROM {LISTINGS}"""
query("overview_totals", "orders", _OVERVIEW)(lambda t: rollups.overview(listings(t), datetime(2001, 1, 8)))
query("overview_shares", "orders", f"""SELECT *, CASE WHEN active > 0 THEN CAST(CAST(round_even(100.0 * remote / active, 0) AS INTEGER) AS VARCHAR) || '%' ELSE '—' END AS remote_share,
    CASE WHEN active > 0 THEN CAST(CAST(round_even(100.0 * with_salary / active, 0) AS INTEGER) AS VARCHAR) || '%' ELSE '—' END AS salary_share FROM ({_OVERVIEW})""")(lambda t: rollups.shares(rollups.overview(listings(t), datetime(2001, 1, 8))))
query("by_source", "orders", "SELECT o_orderstatus AS source, count(*) AS n FROM orders GROUP BY 1")(lambda t: rollups.by_source(listings(t)))

_DAILY = """SELECT CAST(d AS DATE) AS day, CAST(coalesce(n, 0) AS BIGINT) AS n FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) AS s(d)
    LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01 12:00:00' {} GROUP BY 1) c ON c.day = CAST(d AS DATE)"""
query("daily_series_dense", "events", _DAILY.format(""))(lambda t: rollups.daily_series(t, "ts", AS_OF, 30))
query("daily_series_errors", "events", _DAILY.format("AND event_type = 'error'"))(lambda t: rollups.daily_series(t.where("event_type = 'error'"), "ts", AS_OF, 30))


def runs(events: DataFrame) -> DataFrame:
    """events in the shape of runs: purchases succeeded, errors failed."""
    status = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("running")
    return events.select(F.col("event_id").alias("id"), F.col("event_type").alias("adapter"), status.alias("status"), F.col("ts").alias("started_at"), F.col("value").alias("duration_seconds"))


_RUNS = "(SELECT event_id AS id, event_type AS adapter, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts AS started_at, value AS duration_seconds FROM events)"
query("recent_runs", "events", f"SELECT * FROM {_RUNS} ORDER BY started_at DESC, id DESC LIMIT 20")(lambda t: rollups.recent_runs(runs(t)))
query("latest_successful", "events", f"SELECT * FROM {_RUNS} WHERE status = 'succeeded' ORDER BY started_at DESC, id DESC LIMIT 1")(lambda t: rollups.latest_successful(runs(t)))
query("failure_breakdown", "events", "SELECT props AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, error LIMIT 20")(lambda t: rollups.failure_breakdown(t.where("event_type = 'error'"), column="props"))
query("json_props", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")(lambda t: t.select("event_id", F.from_json("props", "k bigint")["k"].alias("k")))
query("status_histogram", "events", "SELECT length(event_type) AS status_code, count(*) AS n FROM events GROUP BY 1")(lambda t: rollups.status_histogram(t.select(F.length("event_type").cast("long").alias("status_code"))))
query("duration_buckets", "events", """SELECT adapter, le, n, c AS count FROM (SELECT event_type AS adapter, count(*) AS c, unnest([{'le': '1.0', 'n': count(*) FILTER (value <= 1)}, {'le': '5.0', 'n': count(*) FILTER (value <= 5)},
    {'le': '+Inf', 'n': count(*)}], recursive := true) FROM events WHERE value IS NOT NULL GROUP BY event_type)""")(lambda t: metrics.histogram(t.where("value is not null").select(F.col("event_type").alias("adapter"), "value"), "value", [1.0, 5.0], "adapter").select("adapter", "le", "n", "count"))


# filters, search, pages ----------------------------------------------------------------------

_KEEP = ["id", "company", "posted_at", "salary_max"]
_FILTERS = {
    "active": (filters.ItemFilters(), "is_active"),
    "company_in": (filters.ItemFilters(companies=("1", "2", "3", "10")), "is_active AND company IN ('1', '2', '3', '10')"),
    "ilike": (filters.ItemFilters(is_active=False, location="UrGe"), "location ILIKE '%UrGe%'"),
    "tristate": (filters.ItemFilters(is_active=None, remote=False), "remote = false"),
    "employment_type": (filters.ItemFilters(employment_type="5-LOW"), "is_active AND employment_type = '5-LOW'"),
    "source": (filters.ItemFilters(is_active=None, source="F"), "source = 'F'"),
    "posted_after": (filters.ItemFilters(posted_after=datetime(2000, 1, 1)), "is_active AND posted_at >= TIMESTAMP '2000-01-01 00:00:00'"),
    "has_value": (filters.ItemFilters(has_salary=True), "is_active AND salary_max IS NOT NULL"),
    "has_no_value": (filters.ItemFilters(has_salary=False), "is_active AND salary_max IS NULL"),
    "min_range": (filters.ItemFilters(min_salary=200000.0), "is_active AND (salary_max >= 200000 OR salary_min >= 200000)"),
    "combined": (filters.ItemFilters(remote=True, min_salary=100000.0, posted_after=datetime(1998, 6, 1), q="urgent o"), "is_active AND remote AND (salary_max >= 100000 OR salary_min >= 100000) AND posted_at >= TIMESTAMP '1998-06-01 00:00:00' AND source = 'O'"),
}
for _name, (_filter, _where) in _FILTERS.items():
    query(f"filter_{_name}", "orders", f"SELECT {', '.join(_KEEP)} FROM {LISTINGS} WHERE {_where}")(lambda t, f=_filter: listings(t).where(f.predicate()).select(*_KEEP))

query("search_substring", "documents", "SELECT doc_id FROM documents WHERE text ILIKE '%ation th%'")(lambda t: t.where(filters.search("ation th", F.col("text"), mode="substring")).select("doc_id"))
_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
query("search_tokens_and", "documents", f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['the', 'of', 'hation'])")(lambda t: spread(t.select("doc_id", "text")).where(filters.search("The OF, hation", F.col("text"))).select("doc_id"))
query("search_indexed", "documents", f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['que', 'les'])")(lambda t: filters.with_tokens(t.withColumnRenamed("text", "search_text")).where(filters.search_indexed("les que", F.col("tokens"))).select("doc_id"))
query("inverted_index", "part", r"SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(p_type), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS token, p_partkey AS id FROM part")(lambda t: filters.inverted_index(t.select(F.col("p_type").alias("search_text"), F.col("p_partkey").alias("id"))))

_PAGE = ["id", "company", "posted_at"]
_PAGES = {
    "first": (filters.ItemFilters(limit=25), "is_active ORDER BY posted_at DESC NULLS LAST, id DESC"),
    "company": (filters.ItemFilters(limit=25, sort="company", descending=False), "is_active ORDER BY company ASC NULLS LAST, id DESC"),
    "next_desc": (filters.ItemFilters(limit=25, cursor=filters.encode_cursor(datetime(2000, 5, 5), 700)), "is_active AND (posted_at < TIMESTAMP '2000-05-05 00:00:00' OR (posted_at = TIMESTAMP '2000-05-05 00:00:00' AND id < 700) OR posted_at IS NULL) ORDER BY posted_at DESC NULLS LAST, id DESC"),
    "next_asc": (filters.ItemFilters(limit=25, descending=False, cursor=filters.encode_cursor(datetime(1996, 5, 5), 700)), "is_active AND (posted_at > TIMESTAMP '1996-05-05 00:00:00' OR (posted_at = TIMESTAMP '1996-05-05 00:00:00' AND id < 700) OR posted_at IS NULL) ORDER BY posted_at ASC NULLS LAST, id DESC"),
    "nulls": (filters.ItemFilters(limit=25, cursor=filters.encode_cursor(None, 900)), "is_active AND posted_at IS NULL AND id < 900 ORDER BY posted_at DESC NULLS LAST, id DESC"),
    "nulls_compat": (filters.ItemFilters(limit=25, cursor=filters.encode_cursor(None, 900), null_safe=False), "is_active AND id < 900 ORDER BY posted_at DESC NULLS LAST, id DESC"),
}


def _ntz_page(t: DataFrame, f: filters.ItemFilters) -> DataFrame:
    items = listings(t).withColumns({c: F.col(c).cast("timestamp") for c in ("posted_at", "first_seen_at")})
    return filters.list_items(items, f).select("id", "company", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


for _name, (_filter, _where) in _PAGES.items():
    query(f"page_{_name}", "orders", f"SELECT {', '.join(_PAGE)} FROM {LISTINGS} WHERE {_where} LIMIT 26")(lambda t, f=_filter: _ntz_page(t, f))

query("item_by_id", "orders", f"SELECT id, source, company FROM {LISTINGS} WHERE id = 7")(lambda t: filters.by_id(listings(t), 7, ["id", "source", "company"]))
query("cursor_encode", "orders", "SELECT o_orderkey, rtrim(replace(replace(base64(encode(o_orderpriority || '|' || o_orderkey)), '+', '-'), '/', '_'), '=') AS cursor FROM orders")(lambda t: t.select("o_orderkey", filters.cursor_column(F.col("o_orderpriority"), F.col("o_orderkey")).alias("cursor")))


# change tracking -----------------------------------------------------------------------------


def stored(orders: DataFrame) -> DataFrame:
    """What is known: two thirds of the orders, a fifth of these with another content."""
    price = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return _tracked(orders.where(F.col("o_orderkey") % 3 != 0), price, "1990-01-01", F.col("o_orderkey") % 2 == 0).withColumn("id", F.col("external_id").cast("long"))


def batch(orders: DataFrame) -> DataFrame:
    """What is seen now: all but a seventh."""
    return _tracked(orders.where(F.col("o_orderkey") % 7 != 0), F.col("o_totalprice"), "2024-01-01", F.lit(True)).withColumn("id", F.lit(None).cast("long"))


def _tracked(orders: DataFrame, price: Column, at: str, active: Column) -> DataFrame:
    from lodestack.schemas import JOB_ITEMS, conform

    when = F.lit(at).cast("timestamp")
    df = orders.select(
        F.col("o_orderstatus").alias("source"), F.col("o_orderkey").cast("string").alias("external_id"), F.col("o_orderpriority").alias("title"), F.lit("c").alias("company"),
        price.alias("salary_max"), when.alias("first_seen_at"), when.alias("last_seen_at"), active.alias("is_active"), F.sha2(F.concat_ws("|", "o_orderpriority", F.round(price, 2).cast("decimal(20,2)").cast("string")), 256).alias("content_hash"),
    )
    return conform(df, JOB_ITEMS)


_STORED = "(SELECT o_orderstatus AS source, CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS salary_max, o_orderkey % 2 = 0 AS is_active FROM orders WHERE o_orderkey % 3 <> 0)"
_BATCH = "(SELECT o_orderstatus AS source, CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, o_totalprice AS salary_max FROM orders WHERE o_orderkey % 7 <> 0)"
_OUTCOME = f"SELECT b.source, b.external_id, CASE WHEN s.source IS NULL THEN 'new' WHEN s.salary_max = b.salary_max THEN 'unchanged' ELSE 'changed' END AS outcome FROM {_BATCH} b LEFT JOIN {_STORED} s USING (source, external_id)"
query("change_classify", "orders", _OUTCOME)(lambda t: merge.classify(stored(t), batch(t)).select("source", "external_id", "outcome"))
query("upsert_stats", "orders", f"SELECT count(*) FILTER (outcome = 'new') AS new, count(*) FILTER (outcome = 'changed') AS changed, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) AS total FROM ({_OUTCOME})")(lambda t: merge.write_stats(merge.classify(stored(t), batch(t))))
_MERGED = f"""SELECT coalesce(s.source, b.source) AS source, coalesce(s.external_id, b.external_id) AS external_id, CASE WHEN b.source IS NULL OR s.salary_max = b.salary_max THEN s.salary_max ELSE b.salary_max END AS salary_max,
    CASE WHEN b.source IS NULL OR s.salary_max = b.salary_max THEN s.is_active ELSE true END AS is_active, CASE WHEN s.source IS NULL THEN 2024 ELSE 1990 END AS first_seen_year,
    CASE WHEN b.source IS NULL OR s.salary_max = b.salary_max THEN 1990 ELSE 2024 END AS last_seen_year FROM {_STORED} s FULL JOIN {_BATCH} b ON s.source = b.source AND s.external_id = b.external_id"""


def _years(df: DataFrame) -> DataFrame:
    return df.select("source", "external_id", "salary_max", "is_active", F.year("first_seen_at").alias("first_seen_year"), F.year("last_seen_at").alias("last_seen_year"))


query("upsert_merge", "orders", _MERGED)(lambda t: _years(merge.merge(stored(t), batch(t))))
query("upsert_touch", "orders", f"""SELECT source, external_id, salary_max, CASE WHEN in_batch THEN true ELSE is_active END AS is_active, first_seen_year, CASE WHEN in_batch THEN 2024 ELSE last_seen_year END AS last_seen_year
    FROM (SELECT m.*, b.source IS NOT NULL AS in_batch FROM ({_MERGED}) m LEFT JOIN {_BATCH} b ON m.source = b.source AND m.external_id = b.external_id)""")(lambda t: _years(merge.merge(stored(t), batch(t), touch_unchanged=True)))
query("surrogate_ids", "orders", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_ids, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 3 <> 0) + count(*) FILTER (o_orderkey % 3 = 0) AS largest FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 7 <> 0")(
    lambda t: merge.merge(stored(t), batch(t)).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.max("id").alias("largest"))
)
query("stale_flag", "orders", f"SELECT source, external_id, CASE WHEN source = 'O' AND is_active AND external_id NOT IN (SELECT external_id FROM {_BATCH}) THEN false ELSE is_active END AS is_active FROM {_STORED}")(
    lambda t: merge.mark_stale(stored(t), "O", batch(t)).select("source", "external_id", "is_active")
)
query("last_of_each", "lineitem", "SELECT l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC) AS n FROM lineitem) WHERE n = 1")(
    lambda t: merge.last_of_each(t.select("l_orderkey", "l_linenumber", "l_shipdate", F.struct("l_linenumber", "l_shipdate").alias("_o")), "_o", ["l_orderkey"])
)


# archive -------------------------------------------------------------------------------------


def snapshots(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(F.col("l_orderkey").alias("url"), F.col("l_shipdate").alias("fetched_at"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), F.col("l_returnflag").alias("adapter"))


_SNAP = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem)"


def _flat(df: DataFrame) -> DataFrame:
    return df.select("url", "fetched_at", F.col("id.l_linenumber").alias("line"), F.col("id.l_partkey").alias("part"))


query("archive_latest", "lineitem", f"SELECT l_orderkey AS url, l_shipdate AS fetched_at, l_linenumber AS line, l_partkey AS part FROM {_SNAP} WHERE n = 1")(lambda t: _flat(archive.latest(snapshots(t))))
query("archive_prune", "lineitem", f"SELECT l_orderkey AS url, l_shipdate AS fetched_at, l_linenumber AS line, l_partkey AS part FROM {_SNAP} WHERE n <= 2")(lambda t: _flat(archive.prune(snapshots(t), 2)))
query("archive_urls", "lineitem", "SELECT l_orderkey AS url, max(l_shipdate) AS last_fetched_at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5000")(lambda t: archive.urls(snapshots(t), "R"))
query("archive_count", "lineitem", "SELECT count(*) AS n FROM lineitem")(lambda t: t.agg(F.count("*").alias("n")))
query("archive_size_guard", "pages", "SELECT page_id FROM pages WHERE strlen(html) > 4000")(lambda t: archive.too_large(t.withColumn("text", F.col("html")), 4000).select("page_id"))
query("archive_round_trip", "pages", "SELECT page_id, sha256(html) AS body FROM pages")(lambda t: t.select("page_id", F.sha2(archive.decompress(archive.compress("html")), 256).alias("body")))
query("page_hash", "pages", "SELECT page_id, sha256(coalesce(html, '')) AS content_hash FROM pages")(lambda t: t.select("page_id", hashing.page_hash(F.col("html")).alias("content_hash")))


# hashes and text -----------------------------------------------------------------------------


def _as_items(part: DataFrame) -> DataFrame:
    c = F.col
    return part.select(
        "p_partkey", c("p_name").alias("title"), c("p_brand").alias("company"), F.lit(None).cast("string").alias("location"), (c("p_size") > 25).alias("remote"), c("p_type").alias("employment_type"),
        c("p_retailprice").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"), F.lit("EUR").alias("salary_currency"), F.lit("").alias("description"), F.split("p_type", " ").alias("tags"),
    )


query("content_hash", "part", """SELECT p_partkey, sha256(concat_ws(chr(31), p_name, p_brand, chr(0), CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END, p_type, CAST(CAST(round(p_retailprice, 2) AS DECIMAL(20, 2)) AS VARCHAR), chr(0), 'EUR', '',
    array_to_string(list_sort(string_split(p_type, ' ')), chr(30)))) AS content_hash FROM part""")(lambda t: _as_items(t).select("p_partkey", hashing.content_hash().alias("content_hash")))
query("content_hash_compat", "part")(lambda t: _as_items(t).select("p_partkey", hashing.content_hash_compat(F.struct(*hashing.CONTENT)).alias("content_hash")))
query("search_text", "part", "SELECT p_partkey, trim(concat_ws(' ', nullif(p_name, ''), nullif(p_brand, ''), nullif(p_type, ''), nullif(replace(p_type, ' ', ' '), ''))) AS search_text FROM part")(
    lambda t: _as_items(t).select("p_partkey", hashing.search_text(*[F.col(c) for c in ("title", "company", "location", "employment_type", "tags", "description")]).alias("search_text"))
)
query("item_key", "orders", "SELECT o_orderkey, o_orderstatus || ':' || o_orderkey AS key FROM orders")(lambda t: t.select("o_orderkey", hashing.item_key(F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("key")))
query("dedupe_exact", "documents", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")(lambda t: t.groupBy(hashing.page_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h"))
query("url_id", "pages")(lambda t: t.select("page_id", hashing.url_id("url").alias("external_id")))
query("truncate_text", "documents", r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(substr(text, 1, 199), '[\s]+$', '') || '…' END AS t FROM documents")(lambda t: t.select("doc_id", text.truncate(F.col("text"), 200).alias("t")))
query("normalise_ws", "documents", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents")(lambda t: t.select("doc_id", text.normalise_ws(F.col("text")).alias("t")))
query("html_strip", "pages", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?i)</(p|div|li|tr|h[1-6]|br)\s*/?>', chr(10), 'g'),
    '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages""")(lambda t: t.select("page_id", text.strip_tags(F.col("html")).alias("t")))
query("html_to_text", "pages")(lambda t: t.select("page_id", text.html_to_text(F.col("html")).alias("t")))
query("normalise_text", "pages")(lambda t: t.select("page_id", text.normalise_text(F.col("html")).alias("t")))
query("title_extract", "pages", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""")(
    lambda t: t.select("page_id", markup.extract_first(F.col("html"), "title::text").alias("title"))
)
query("link_extract", "pages", r"""SELECT page_id, list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: x <> '') AS links FROM pages""")(lambda t: t.select("page_id", markup.extract_all(F.col("html"), "a::attr(href)").alias("links")))
query("nav_extract", "pages", r"""SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>')) AS n_links FROM pages""")(lambda t: t.select("page_id", F.size(markup.extract_all(F.col("html"), "nav > ul li a::attr(href)")).cast("long").alias("n_links")))
query("scrub_email", "documents", rf"SELECT doc_id, regexp_replace(text, '\b[\w.+-]+@[\w-]+\.[\w.-]{{2,}}\b', '{text.REDACTED}', 'g') AS t FROM documents")(lambda t: spread(t).select("doc_id", text.redact_emails(F.col("text")).alias("t")))
query("scrub_phone", "documents")(lambda t: spread(t).select("doc_id", text.redact_phones(F.col("text")).alias("t")))
query("scrub_pii", "documents")(lambda t: spread(t).select("doc_id", text.scrub_pii(F.col("text")).alias("t")))

# Fixed value: the pattern of amounts, as SQL writes it.
_MONEY = r"([$£€₹]|\b(?:usd|eur|gbp|cad|aud|inr|chf|sek|nok|dkk|pln|ils|brl|jpy)\b)?\s*(\d{1,3}(?:[,\x{00a0} ]\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*([kKmM])?\b"
_PAY = r"(SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '$' || (o_orderkey % 900 + 10) || 'k - $' || (o_orderkey % 700 + 20) || 'k' WHEN 1 THEN (o_orderkey % 90) || ',500 EUR' WHEN 2 THEN 'salary ' || o_orderkey WHEN 3 THEN 'none' ELSE '£1.' || (o_orderkey % 10) || 'M' END AS s FROM orders)"


def _pay(t: DataFrame) -> DataFrame:
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    value = F.when(k % 5 == 0, F.concat(F.lit("$"), s(k % 900 + 10), F.lit("k - $"), s(k % 700 + 20), F.lit("k"))).when(k % 5 == 1, F.concat(s(k % 90), F.lit(",500 EUR"))).when(k % 5 == 2, F.concat(F.lit("salary "), s(k))).when(k % 5 == 3, "none").otherwise(F.concat(F.lit("£1."), s(k % 10), F.lit("M")))
    return t.select("o_orderkey", value.alias("s"))


_AMOUNTS = f"(SELECT o_orderkey, s, list_transform(list_zip(regexp_extract_all(s, '(?i){_MONEY}', 2), regexp_extract_all(s, '(?i){_MONEY}', 3)), lambda z: round(CAST(replace(z[1], ',', '') AS DOUBLE) * CASE lower(z[2]) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END, 2)) AS a FROM {_PAY})"
query("money_tokens", "orders", f"SELECT o_orderkey, a AS tokens FROM {_AMOUNTS}")(lambda t: _pay(t).select("o_orderkey", text.money_tokens(F.col("s")).alias("tokens")))
query("parse_salary", "orders", f"""SELECT o_orderkey, least(a[1], coalesce(a[2], a[1])) AS low, greatest(a[1], coalesce(a[2], a[1])) AS high, CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 4 THEN 'GBP' END AS currency FROM {_AMOUNTS}""")(
    lambda t: _pay(t).withColumn("p", text.parse_salary(F.col("s"))).select("o_orderkey", F.col("p.min").alias("low"), F.col("p.max").alias("high"), F.col("p.currency").alias("currency"))
)
query("salary_display", "orders", f"""SELECT o_orderkey, CASE WHEN len(a) = 0 THEN '—' WHEN o_orderkey % 5 = 0 AND a[1] <> a[2] THEN CAST(least(a[1], a[2]) / 1000 AS BIGINT) || 'k – ' || CAST(greatest(a[1], a[2]) / 1000 AS BIGINT) || 'k' WHEN a[1] >= 1000 AND a[1] % 1000 = 0 THEN CAST(a[1] / 1000 AS BIGINT) || 'k' ELSE format('{{:,}}', CAST(a[1] AS BIGINT)) END AS shown FROM {_AMOUNTS}""")(
    lambda t: _pay(t).withColumn("p", text.parse_salary(F.col("s"))).select("o_orderkey", display.salary_display(F.col("p.min"), F.col("p.max"), F.lit(None).cast("string")).alias("shown"))
)
query("detect_currency", "documents", r"""SELECT doc_id, coalesce(nullif(upper(regexp_extract(text, '(?i)\b(usd|eur|gbp|cad|aud|inr|chf|sek|nok|dkk|pln|ils|brl|jpy)\b', 1)), ''), CASE WHEN contains(text, '$') THEN 'USD' WHEN contains(text, '£') THEN 'GBP' WHEN contains(text, '€') THEN 'EUR' WHEN contains(text, '₹') THEN 'INR' END) AS currency FROM documents""")(
    lambda t: t.select("doc_id", text.detect_currency(F.col("text")).alias("currency"))
)
_DATES = {"iso": ("yyyy-MM-dd", "%Y-%m-%d"), "us": ("MM/dd/yyyy", "%m/%d/%Y"), "month_first": ("MMM d, yyyy", "%b %-d, %Y"), "day_first": ("d MMMM yyyy", "%-d %B %Y")}
for _name, (_java, _c) in _DATES.items():
    query(f"parse_date_{_name}", "orders", "SELECT o_orderkey, date_trunc('day', o_orderdate) AS d FROM orders")(lambda t, j=_java: t.select("o_orderkey", text.parse_date(F.date_format("o_orderdate", j)).cast("timestamp_ntz").alias("d")))
query("posted_display", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '—' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS shown FROM orders")(lambda t: listings(t).select(F.col("id").alias("o_orderkey"), display.posted_display(F.col("posted_at")).alias("shown")))

_TITLES = ["Full-time clerk (remote)", "Contract pilot", "Summer internship, Go and Java", "Freelance, work from home", "Temporary guard", "Part time cook", "Co-op student", "Captain of docker ships"]


def _titles(t: DataFrame) -> DataFrame:
    return t.select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in _TITLES]), (F.col("p_partkey") % len(_TITLES) + 1).cast("int")).alias("s"))


_TITLE_SQL = f"(SELECT p_partkey, [{', '.join(repr(x) for x in _TITLES)}][p_partkey % {len(_TITLES)} + 1] AS s FROM part)"
query("looks_remote", "part", rf"SELECT p_partkey, regexp_matches(s, '(?i){text.REMOTE}') AS remote FROM {_TITLE_SQL}")(lambda t: _titles(t).select("p_partkey", text.looks_remote(F.col("s")).alias("remote")))
query("employment_type", "part", f"SELECT p_partkey, CASE {' '.join(f'WHEN contains(lower(s), {n!r}) THEN {v!r}' for n, v in text.EMPLOYMENT_TYPES.items())} WHEN regexp_matches(lower(s), '{text.INTERNSHIP}') THEN 'internship' END AS kind FROM {_TITLE_SQL}")(
    lambda t: _titles(t).select("p_partkey", text.detect_employment_type(F.col("s")).alias("kind"))
)
query("tech_tags", "part", f"SELECT p_partkey, list_filter([{', '.join(repr(x) for x in text.TECH_TAGS)}], lambda x: contains(lower(s), x)) AS tags FROM {_TITLE_SQL}")(lambda t: _titles(t).select("p_partkey", text.tech_tags(F.col("s")).alias("tags")))
query("split_tags", "part", "SELECT p_partkey, list_filter(string_split(replace(p_type, ' ', ','), ','), lambda x: x <> '') AS tags FROM part")(lambda t: t.select("p_partkey", text.split_tags(F.regexp_replace("p_type", " ", ", ")).alias("tags")))
query("remote_tag", "part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN list_append(string_split(p_type, ' '), 'remote') ELSE string_split(p_type, ' ') END AS tags FROM part")(lambda t: t.select("p_partkey", text.with_remote_tag(F.split("p_type", " "), F.col("p_size") > 25).alias("tags")))
query("hiring_thread", "part", f"SELECT p_partkey, p_partkey % 3 = 0 AS hiring FROM {_TITLE_SQL}")(lambda t: t.select("p_partkey", text.is_hiring_thread(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Ask: Who is HIRING? "), "p_name")).otherwise(F.col("p_name"))).alias("hiring")))


# urls and traversal --------------------------------------------------------------------------

_CANON = r"""lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?', 0)) || regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) ||
    coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '')), '&'), ''), '')"""
query("canonical_url", "pages", f"SELECT page_id, {_CANON} AS canon FROM pages")(lambda t: t.select("page_id", urls.canonical_url(F.col("url")).alias("canon")))
query("host_of", "pages", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages")(lambda t: t.select("page_id", urls.host_of(F.col("url")).alias("host")))
query("robots_url", "pages", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/robots.txt' AS robots FROM pages")(lambda t: t.select("page_id", urls.robots_url(F.col("url")).alias("robots")))
query("strip_query", "pages", "SELECT page_id, string_split(url, '?')[1] AS bare FROM pages")(lambda t: t.select("page_id", urls.strip_query(F.col("url")).alias("bare")))
query("same_site", "pages", r"""SELECT page_id, h = 'example.net' OR h LIKE '%.example.net' AS same FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS h FROM pages)""")(
    lambda t: t.select("page_id", urls.same_site(F.col("url"), F.lit("http://www.example.net/x")).alias("same"))
)
query("absolute_url", "pages")(lambda t: t.select("page_id", F.explode(markup.extract_all(F.col("html"), "a::attr(href)")).alias("href"), "url").select("page_id", urls.absolute_url("url", "href").alias("link")))


def _pushes(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("url"), F.when(F.col("page_id") % 11 == 0, 3).otherwise(1).alias("depth"), F.col("page_id").alias("seq"))


query("frontier_dedup", "pages", r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u, page_id % 11 = 0 AS deep FROM pages)
    SELECT page_id, CASE WHEN deep THEN 'too_deep' WHEN row_number() OVER (PARTITION BY u, deep ORDER BY page_id) = 1 THEN 'queued' ELSE 'duplicate' END AS verdict FROM p""")(
    lambda t: frontier.admit(_pushes(t), t.select("url").limit(0).withColumnRenamed("url", "canon"), 2, 1 << 40).select("page_id", "verdict")
)


def _bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations reach the nations that follow in their region."""
    nation = table(spark, sf_dir, "nation")
    a, b = nation.select(F.col("n_nationkey").alias("src"), "n_regionkey"), nation.select(F.col("n_nationkey").alias("dst"), "n_regionkey")
    edges = a.join(b, "n_regionkey").where("dst > src and dst <= src + 6").select("src", "dst")
    return frontier.reachable(edges, nation.where("n_nationkey < 5").select(F.col("n_nationkey").alias("node")), 3, lambda df, _: df)


QUERIES["frontier_bfs"] = _bfs
ORACLE["frontier_bfs"] = """WITH RECURSIVE e AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b USING (n_regionkey) WHERE b.n_nationkey > a.n_nationkey AND b.n_nationkey <= a.n_nationkey + 6),
    r AS (SELECT n_nationkey AS node, 0 AS depth FROM nation WHERE n_nationkey < 5 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 3)
    SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node"""


# policies ------------------------------------------------------------------------------------

query("backoff_ceiling", "events", "SELECT event_id, least(30.0, 0.5 * pow(2, event_id % 8)) AS ceiling FROM events")(lambda t: t.select("event_id", policy.backoff_ceiling(F.col("event_id") % 8).alias("ceiling")))
query("status_class", "events", "SELECT event_id, CASE WHEN s IN (408, 425, 429) OR s >= 500 THEN 'retry' WHEN s IN (400, 401, 403, 404, 405, 410, 451) THEN 'fatal' WHEN s BETWEEN 200 AND 399 THEN 'ok' ELSE 'other' END AS class FROM (SELECT event_id, 200 + event_id % 400 AS s FROM events)")(
    lambda t: t.select("event_id", policy.status_class(200 + F.col("event_id") % 400).alias("class"))
)


def _log(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok")).withColumn("ts", F.col("us") / 1e6).drop("us")


query("breaker_replay", "events")(lambda t: policy.replay_breaker(_log(t), 2, 3600.0))
query("token_bucket_replay", "events")(lambda t: policy.replay_bucket(_log(t), 0.001))
query("breaker_states", "events")(lambda t: policy.breaker_states(policy.replay_breaker(_log(t), 2, 3600.0)))


def _robots(pages: DataFrame) -> DataFrame:
    hosts = pages.select(urls.host_of(F.col("url")).alias("host")).distinct()
    body = "User-agent: *\nDisallow: /de/\nCrawl-delay: 2\n"
    answers = hosts.select("host", F.when(F.length("host") % 4 == 0, 404).when(F.length("host") % 4 == 1, 503).otherwise(200).alias("status"), F.lit(body).alias("body"))
    return policy.check_robots(pages.select("page_id", "url"), answers, "bot", 1.0).select("page_id", F.col("verdict.allowed").alias("allowed"), F.col("verdict.crawl_delay").alias("crawl_delay"))


query("robots_check", "pages", r"""SELECT page_id, n % 4 = 0 OR (n % 4 > 1 AND NOT starts_with(p, '/de/')) AS allowed, CASE WHEN n % 4 = 0 THEN 1.0 WHEN n % 4 > 1 AND NOT starts_with(p, '/de/') THEN 2.0 END AS crawl_delay
    FROM (SELECT page_id, length(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS n, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")(_robots)


# parsers -------------------------------------------------------------------------------------


def _board(pages: DataFrame) -> DataFrame:
    """Pages as details of a board: heading, host as company, article as description."""
    from lodestack.operators import board
    from lodestack.sources.board_config import BoardConfig

    config = BoardConfig.from_mapping({
        "name": "pages", "start_urls": ["http://example.com/"], "list": {"item_selector": "li", "url": "a::attr(href)"},
        "detail": {"fields": {"title": "h1::text", "company": "title::text", "description": "article::html", "tags": "nav li::text"}, "remove": "script, style, div.ad"},
    })
    return board.build_items(board.details_of(pages.select("url", F.col("html").alias("text")), config), config).select("url", "external_id", "title", "description", "remote", F.size("tags").alias("n_tags"))


query("board_parse", "pages")(_board)
query("thread_parse", "documents")(lambda t: thread.parse_comments(t.select("doc_id", F.concat(F.lit("<p>Firm | Role</p>\n<p>Location: Oslo</p>\n<p>"), F.col("text"), F.lit("</p>")).alias("text"))).select("doc_id", "posting.company", "posting.location", "posting.remote", "posting.description", F.size("posting.tags").alias("n_tags")))
