"""Whole runs over the driver's tables, with SQL that says what they must leave behind.

The table part is published as a board (index pages, details, one missing page in fifty) and as
discussion threads, events are a stream, pages are fetched from a transport that answers by url.
A board is crawled, changes, is crawled again and parsed again from its archive; the queries read
the tables that this leaves. The runs of a session and folder are made once.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.config import Settings
from lodestack.functions import hashing, text, urls
from lodestack.operators import filters, merge, metrics, policy, rollups
from lodestack.plans import service
from lodestack.plans.catalog import LISTINGS, ORACLE, QUERIES, _log, listings, query, table
from lodestack.plans.pipeline import Store, crawl, reparse
from lodestack.schemas import JOB_ITEMS, conform, orphans
from lodestack.session import scratch_dir
from lodestack.sources import http, recorded
from lodestack.sources.adapters import BoardAdapter, ThreadAdapter
from lodestack.sources.board_config import BoardConfig
from lodestack.streaming import incremental

DAYS = [datetime(2026, 3, d) for d in (1, 2, 3)]
PER_PAGE = 1000
SITE = "https://parts.example"
BOARD = {
    "name": "parts", "start_urls": [f"{SITE}/list?page=1"], "base_url": SITE,
    "list": {"item_selector": "div.card", "url": "a.open::attr(href)", "fields": {"title": "h2::text", "location": "span.place::text", "posted_at": "time::attr(datetime)"}},
    "detail": {"fields": {"title": "h1::text", "company": "span.firm::text", "description": "div.body::html", "employment_type": "span.kind::text", "salary": "span.pay::text", "tags": "ul.skills li::text"}},
    "pagination": {"max_pages": None, "next_selector": "a.next"},
}


def site(part: DataFrame, later: bool = False) -> DataFrame:
    """The board's pages (url, text). Later, a seventh of the parts is gone and a fifth costs one more."""
    key = F.col("p_partkey")
    if later:
        part = part.where(key % 7 != 0)
    price = F.when(F.lit(later) & (key % 5 == 0), F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    at = F.concat(F.lit("/p/"), key.cast("string"))
    card = F.format_string('<div class="card"><h2>%s</h2><a class="open" href="%s">go</a><span class=place>%s</span><time datetime="%s">x</time></div>', "p_name", at, F.when(F.col("p_size") > 25, "Remote").otherwise("Oslo"), F.date_add(F.lit("2026-01-01").cast("date"), (key % 28).cast("int")).cast("string"))
    listed = part.groupBy((F.floor(key / PER_PAGE) + 1).cast("int").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("card")))), lambda x: x["card"]), "").alias("cards"))  # PER_PAGE rows
    top = listed.agg(F.max("k").alias("top"))
    more = F.when(F.col("k") < F.col("top"), F.format_string('<a class="next" href="/list?page=%d">next</a>', F.col("k") + 1)).otherwise("")
    lists = listed.crossJoin(F.broadcast(top)).select(F.concat(F.lit(f"{SITE}/list?page="), F.col("k").cast("string")).alias("url"), F.concat("cards", more).alias("text"))
    body = F.format_string("<h1>%s</h1><span class=firm>%s</span><span class=kind>%s</span><span class=pay>USD %s</span><div class=body><p>Kind %s.</p><p>Call +1 (555) 123-4567 or a@b.example now.</p></div><ul class=skills><li>%s</li><li>size %s</li></ul>",
                           "p_name", "p_brand", F.when(F.col("p_size") % 2 == 0, "Full time").otherwise("Contract"), price.cast("string"), "p_type", "p_type", F.col("p_size").cast("string"))
    details = part.where(key % 50 != 49).select(F.concat(F.lit(SITE), at).alias("url"), body.alias("text"))
    return lists.union(details)


_sites: dict[tuple[str, str], Store] = {}


def runs(spark: SparkSession, sf_dir: str) -> Store:
    """A store after a crawl, a crawl of the changed board, and a second parse."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _sites:
        part = table(spark, sf_dir, "part")
        store = Store(spark, f"{scratch_dir(spark)}/parts-{uuid.uuid4().hex}")
        depth = (part.agg(F.max("p_partkey")).first()[0] or 0) // PER_PAGE + 2
        adapter, settings = BoardAdapter(BoardConfig.from_mapping(BOARD)), Settings(max_depth=depth, max_pages=1 << 40)
        for later in (False, True):
            crawl(store, adapter, recorded.Recorded(store.scratch(site(part, later), "site")), DAYS[later], settings)
        reparse(store, adapter, DAYS[2], limit=1 << 30)
        _sites[key] = store
    return _sites[key]


def scenario(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


_PART = """(SELECT *, p_partkey % 50 <> 49 AS there, p_partkey % 7 = 0 AS gone, p_partkey % 5 = 0 AND p_partkey % 7 <> 0 AS dearer, p_retailprice + CASE WHEN p_partkey % 5 = 0 AND p_partkey % 7 <> 0 THEN 1 ELSE 0 END AS price FROM part)"""
_ITEMS = f"""SELECT '{SITE}/p/' || p_partkey AS url, p_name AS title, p_brand AS company, CASE WHEN p_size > 25 THEN 'Remote' ELSE 'Oslo' END AS location, p_size > 25 AS remote,
    CASE WHEN p_size % 2 = 0 THEN 'full-time' ELSE 'contract' END AS employment_type, price AS salary_min, price AS salary_max, 'USD' AS salary_currency, 'Kind ' || p_type || '. Call [redacted] or [redacted] now.' AS description,
    array_to_string(list_concat([p_type, 'size ' || p_size], CASE WHEN p_size > 25 THEN ['remote'] ELSE [] END), '|') AS tags, strftime(DATE '2026-01-01' + CAST(p_partkey % 28 AS INTEGER), '%Y-%m-%d') AS posted FROM {_PART} WHERE there"""
_SHOWN = ["url", "title", "company", "location", "remote", "employment_type", "salary_min", "salary_max", "salary_currency", "description"]


@scenario("board_crawl_items", _ITEMS)
def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).read("job_items").select(*_SHOWN, F.array_join("tags", "|").alias("tags"), F.date_format("posted_at", "yyyy-MM-dd").alias("posted"))


@scenario("board_crawl_changes", f"SELECT '{SITE}/p/' || p_partkey AS url, NOT gone AS is_active, CAST(1 AS BIGINT) AS first_seen, CAST(CASE WHEN dearer THEN 2 ELSE 1 END AS BIGINT) AS last_seen, CAST(CASE WHEN gone OR dearer THEN 2 ELSE 1 END AS BIGINT) AS run_id FROM {_PART} WHERE there")
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.dayofmonth(c).cast("long")
    return runs(spark, sf_dir).read("job_items").select("url", "is_active", day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"), "run_id")


_COUNTS = f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (NOT there) AS lost, count(*) FILTER (there) AS ok, count(*) FILTER (gone AND there) AS gone, count(*) FILTER (NOT gone) AS n2, count(*) FILTER (NOT gone AND NOT there) AS lost2,
    count(*) FILTER (dearer AND there) AS dearer, count(*) FILTER (NOT gone AND there) AS ok2, max(p_partkey) // {PER_PAGE} + 1 AS lists FROM {_PART}),
    r AS (SELECT 1 AS id, lists + ok AS pages_fetched, lists + n AS requests_made, lost AS failures, ok AS items_seen, ok AS items_new, 0 AS items_changed, 0 AS items_unchanged, lists AS max_depth_reached, 0 AS marked FROM c
    UNION ALL SELECT 2, lists + ok2, lists + n2, lost2, ok2, 0, dearer, ok2 - dearer, lists, gone FROM c UNION ALL SELECT 3, lists + ok, 0, 0, ok, 0, 0, ok, 0, 0 FROM c)"""
_COUNTERS = ["pages_fetched", "requests_made", "failures", "items_seen", "items_new", "items_changed", "items_unchanged", "max_depth_reached"]


@scenario("board_crawl_counters", f"{_COUNTS} SELECT CAST(id AS BIGINT) AS id, 'parts' AS adapter, 'succeeded' AS status, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _COUNTERS)}, CAST(marked AS BIGINT) AS marked FROM r")
def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).read("crawl_runs").select("id", "adapter", "status", *[F.col(c).cast("long").alias(c) for c in _COUNTERS], F.get_json_object("detail", "$.marked_inactive").cast("long").alias("marked"))


@scenario("board_crawl_errors", f"SELECT CAST(run_id AS BIGINT) AS run_id, '{SITE}/p/' || p_partkey AS url, 'HTTP 404 for {SITE}/p/' || p_partkey AS error FROM (SELECT *, unnest([1, 2]) AS run_id FROM {_PART}) WHERE NOT there AND (run_id = 1 OR NOT gone)")
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).read("fetch_errors").select("run_id", "url", "error")


@scenario("run_detail_frame", f"{_COUNTS} SELECT CAST(1 AS BIGINT) AS id, 'succeeded' AS status, CAST(failures AS BIGINT) AS failures, CAST(least(20, failures) AS BIGINT) AS n_errors FROM r WHERE id = 1")
def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.Service(runs(spark, sf_dir)).run(1).select("id", "status", F.col("failures").cast("long").alias("failures"), F.size("errors").cast("long").alias("n_errors"))


@scenario("run_orphans", "SELECT 'none' AS kind, CAST(0 AS BIGINT) AS n")
def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors whose run is not known: none."""
    store = runs(spark, sf_dir)
    return orphans(store.read("fetch_errors"), "run_id", store.read("crawl_runs")).agg(F.count("*").alias("n")).select(F.lit("none").alias("kind"), "n")


@scenario("board_archive", f"""SELECT 'list' AS kind, {PER_PAGE} AS per_page, CAST(2 * (max(p_partkey) // {PER_PAGE} + 1) AS BIGINT) AS n, CAST(max(p_partkey) // {PER_PAGE} + 1 AS BIGINT) AS n_urls FROM {_PART}
    UNION ALL SELECT 'detail', {PER_PAGE}, count(*) FILTER (there) + count(*) FILTER (there AND NOT gone), count(*) FILTER (there) FROM {_PART}""")
def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).read("raw_pages").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls")).select("kind", F.lit(PER_PAGE).alias("per_page"), "n", "n_urls")


@scenario("listing_frame", """SELECT p_name AS "Title", p_brand AS "Company", CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS "Remote", CASE WHEN p_size % 2 = 0 THEN 'full-time' ELSE 'contract' END AS "Type", strftime(DATE '2026-01-01' + CAST(p_partkey % 28 AS INTEGER), '%Y-%m-%d') AS "Posted" FROM part WHERE p_partkey % 50 <> 49""")
def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.listing_frame(runs(spark, sf_dir).read("job_items")).select("Title", "Company", "Remote", "Type", "Posted")


# threads -------------------------------------------------------------------------------------

API = "https://talk.example"
#: Threads have ids from here on, as a thread and a comment share the space of ids and parts are comments; a multiple of ten.
FIRST_THREAD = 10**18


def talk(part: DataFrame, search: str) -> DataFrame:
    """Answers (url, text) of a discussion site: even and odd parts are comments of two threads; a third thread is beyond the limit."""
    spark, key = part.sparkSession, F.col("p_partkey")
    hits = ", ".join(f'{{"objectID": "{FIRST_THREAD + k}", "title": "{t}", "created_at_i": {1772323200 + k}}}' for k, t in enumerate(["Who is hiring? (A)", "Who is HIRING? (B)", "Who is hiring? (C)"]))
    first = spark.createDataFrame([(search, f'{{"hits": [{{"objectID": "9", "title": "Show"}}, {hits}]}}')], "url string, text string")
    threads = part.groupBy((FIRST_THREAD + key % 2).alias("id")).agg(F.sort_array(F.collect_list(key)).alias("kids")).select(F.concat(F.lit(f"{API}/item/"), F.col("id").cast("string"), F.lit(".json")).alias("url"), F.to_json(F.struct("id", (F.lit(1772323200) + F.col("id") % 10).alias("time"), "kids")).alias("text"))
    said = F.format_string("<p>%s | %s</p><p>Location: Oslo</p>%s<p>Salary: USD %s</p><p>%s Python. Mail a@b.example.</p>", "p_brand", "p_name", F.when(key % 4 == 1, "<p>Remote</p>").otherwise(""), F.col("p_retailprice").cast("string"), F.when(key % 10 == 5, "We&#39;re not hiring.").otherwise("We use"))
    comment = F.to_json(F.struct(key.alias("id"), (FIRST_THREAD + key % 2).alias("parent_id"), said.alias("text"), (key % 10 == 3).alias("deleted"), (key % 10 == 4).alias("dead")))
    return first.union(threads).union(part.select(F.concat(F.lit(f"{API}/item/"), key.cast("string"), F.lit(".json")).alias("url"), comment.alias("text")))


@scenario("thread_crawl_items", f"""SELECT CAST(p_partkey AS VARCHAR) AS external_id, '{API}/web/' || p_partkey AS url, p_name AS title, p_brand AS company, 'Oslo' AS location, p_partkey % 4 = 1 AS remote, p_retailprice AS salary_min, p_retailprice AS salary_max, 'USD' AS salary_currency,
    'We use Python. Mail [redacted].' AS description, CASE WHEN p_partkey % 4 = 1 THEN 'remote|python' ELSE 'python' END AS tags, strftime(TIMESTAMP '2026-03-01 00:00:00' + INTERVAL 1 SECOND * (p_partkey % 2), '%Y-%m-%d %H:%M:%S') AS posted FROM part WHERE p_partkey % 10 NOT IN (3, 4, 5)""")
def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    adapter = ThreadAdapter(f"{API}/search", f"{API}/item", f"{API}/web/{{id}}", most_comments=1 << 30)
    answers = talk(table(spark, sf_dir, "part"), adapter.start(spark).first()["url"])
    store = Store(spark, f"{scratch_dir(spark)}/threads-{uuid.uuid4().hex}")
    crawl(store, adapter, lambda f: recorded.answer(f, answers), DAYS[0], Settings(max_pages=1 << 40, max_depth=3))
    return store.read("job_items").select("external_id", "url", "title", "company", "location", "remote", "salary_min", "salary_max", "salary_currency", "description", F.array_join("tags", "|").alias("tags"), F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted"))


# fetching ------------------------------------------------------------------------------------


def _transport():
    """Answers by the length of the url: always 503, 404, first 429 then 200, no answer at all, or 200; robots.txt forbids nothing."""
    calls: dict[str, int] = {}

    def get(url: str, timeout: float) -> tuple[int, str, dict[str, str]]:
        if url.endswith("/robots.txt"):
            return 404, "", {}
        calls[url] = calls.get(url, 0) + 1
        kind = len(url) % 5
        if kind == 3:
            raise OSError("no route")
        if kind == 2 and calls[url] % 2:
            return 429, "slow", {"retry-after": "1"}
        return {0: 503, 1: 404}.get(kind, 200), "hello", {}

    return get


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    quick = Settings(max_retries=2, requests_per_second=1e6, crawl_delay=0, breaker_threshold=1 << 30, host_concurrency=1)
    return http.fetch(table(spark, sf_dir, "pages").select("page_id", "url"), _transport(), quick, sleep=lambda s: None)


_HTTP = """(SELECT page_id, url, CAST(CASE length(url) % 5 WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 3 THEN NULL ELSE 200 END AS INTEGER) AS status_code, CAST(CASE length(url) % 5 WHEN 0 THEN 2 WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS retries,
    CASE length(url) % 5 WHEN 3 THEN 'unreachable' ELSE 'fetched' END AS reason, CAST(CASE length(url) % 5 WHEN 0 THEN 15 WHEN 3 THEN 0 WHEN 2 THEN 9 ELSE 5 END AS BIGINT) AS bytes FROM pages)"""


@scenario("http_fetch", f"SELECT page_id, status_code, retries, CAST(retries + 1 AS INTEGER) AS requests, reason, bytes FROM {_HTTP}")
def _http(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fetched(spark, sf_dir).select("page_id", "status_code", "retries", "requests", "reason", "bytes")


@scenario("http_request_log", f"SELECT CAST(sum(retries + 1) AS BIGINT) AS requests, CAST(sum(retries) AS BIGINT) AS retries, count(*) FILTER (coalesce(status_code, 999) >= 400) AS failures, CAST(0 AS BIGINT) AS robots_denied, CAST(0 AS BIGINT) AS circuit_skips, CAST(sum(bytes) AS BIGINT) AS bytes_downloaded FROM {_HTTP}")
def _http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return http.request_log(_fetched(spark, sf_dir)).drop("statuses", "breakers")


@scenario("http_statuses", f"SELECT status, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(CASE length(url) % 5 WHEN 0 THEN [{{'status': '503', 'n': 3}}] WHEN 1 THEN [{{'status': '404', 'n': 1}}] WHEN 2 THEN [{{'status': '429', 'n': 1}}, {{'status': '200', 'n': 1}}] WHEN 4 THEN [{{'status': '200', 'n': 1}}] END, recursive := true) FROM pages) GROUP BY status")
def _http_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return http.request_log(_fetched(spark, sf_dir)).select(F.explode("statuses").alias("status", "n"))


# Per host, in order: state, failures and opening time of a breaker of threshold 2 that resets after an hour.
_EVENTS = "(SELECT CAST(user_id AS VARCHAR) AS host, epoch_us(ts) / 1e6 AS ts, event_id AS seq, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
_BREAKER = f"""WITH RECURSIVE e AS {_EVENTS}, b AS (
    SELECT host, k, ts, seq, ok, true AS allowed, 'closed' AS state, CAST(CASE WHEN ok THEN 0 ELSE 1 END AS BIGINT) AS failures, CAST(0 AS DOUBLE) AS opened FROM e WHERE k = 1
    UNION ALL SELECT e.host, e.k, e.ts, e.seq, e.ok, b.state = 'closed' OR e.ts - b.opened >= 3600,
        CASE WHEN b.state = 'open' AND e.ts - b.opened < 3600 THEN 'open' WHEN e.ok THEN 'closed' WHEN b.state = 'open' OR b.failures + 1 >= 2 THEN 'open' ELSE 'closed' END,
        CASE WHEN b.state = 'open' AND e.ts - b.opened < 3600 THEN b.failures WHEN e.ok THEN 0 WHEN b.state = 'open' THEN b.failures ELSE b.failures + 1 END,
        CASE WHEN NOT e.ok AND ((b.state = 'open' AND e.ts - b.opened >= 3600) OR (b.state = 'closed' AND b.failures + 1 >= 2)) THEN e.ts ELSE b.opened END
    FROM b JOIN e ON e.host = b.host AND e.k = b.k + 1)"""
ORACLE["breaker_replay"] = f"{_BREAKER} SELECT host, ts, seq, ok, allowed, state FROM b"
_LAST = "SELECT host, arg_max(state, k) AS state FROM b GROUP BY host"
query("breaker_last_state", "events", f"{_BREAKER} {_LAST}")(lambda t: policy.replay_breaker(_log(t), 2, 3600.0).groupBy("host").agg(F.max_by("state", F.struct("ts", "seq")).alias("state")))
query("breaker_reset", "events", f"{_BREAKER} SELECT host, CASE WHEN host IN ('1', '7', '42') THEN 'closed' ELSE state END AS state FROM ({_LAST})")(
    lambda t: policy.reset_breakers(policy.replay_breaker(_log(t), 2, 3600.0).groupBy("host").agg(F.max_by("state", F.struct("ts", "seq")).alias("state")), "1", "7", "42")
)
_BUCKET = f"""WITH RECURSIVE e AS {_EVENTS}, b AS (SELECT host, k, ts, seq, CAST(0 AS DOUBLE) AS tokens, ts AS ready, CAST(0 AS DOUBLE) AS waited FROM e WHERE k = 1
    UNION ALL SELECT host, k, ts, seq, held + (greatest(ts, was) + greatest(0, (1 - held) / 0.001) - greatest(ts, was)) * 0.001 - 1, greatest(ts, was) + greatest(0, (1 - held) / 0.001), greatest(ts, was) + greatest(0, (1 - held) / 0.001) - ts
    FROM (SELECT e.host, e.k, e.ts, e.seq, b.ready AS was, CASE WHEN e.ts > b.ready THEN least(1, b.tokens + (e.ts - b.ready) * 0.001) ELSE b.tokens END AS held FROM b JOIN e ON e.host = b.host AND e.k = b.k + 1))"""
query("token_bucket_waits", "events", f"{_BUCKET} SELECT host, seq, round(waited, 2) AS waited FROM b")(lambda t: policy.replay_bucket(_log(t), 0.001).select("host", "seq", F.round("waited", 2).alias("waited")))
query("retry_after", "events", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 90 AS DOUBLE) WHEN 1 THEN 0.0 WHEN 2 THEN CAST(event_id % 1000 AS DOUBLE) END AS seconds FROM events")(
    lambda t: t.select("event_id", text.retry_after_seconds(F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 90).cast("string")).when(F.col("event_id") % 4 == 1, "-7").when(F.col("event_id") % 4 == 2, F.concat(F.date_format(F.timestamp_seconds(F.lit(1767225600) + F.col("event_id") % 1000), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon"), F.timestamp_seconds(F.lit(1767225600))).alias("seconds"))
)


# streams -------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, make, mode: str = "append", rocks: bool = False) -> DataFrame:
    """What a stream over the events leaves behind when it has read all there is."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out, root = make(incremental.timed(source)), f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    keep = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/out")
    name, own = "spark.sql.streaming.stateStore.providerClass", None
    if rocks:
        own = spark.conf.get(name)
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        if rocks:
            spark.conf.set(name, own)
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@scenario("stream_daily_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda e: incremental.daily_counts(e, "ts", "1 day", "event_type"), "complete")


@scenario("stream_new_urls", "SELECT DISTINCT 'http://h.example/' || user_id AS canon FROM events")
def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda e: incremental.new_urls(e.select("ts", F.concat(F.lit("HTTP://h.example/"), F.col("user_id").cast("string"), F.lit("#x")).alias("url")), "ts", "400 days")).select("canon")


@scenario("stream_last_seen", "SELECT user_id, max(ts) AS last_seen_at, count(*) AS n FROM events GROUP BY user_id")
def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda e: incremental.last_seen(e, "user_id"), "complete").withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp_ntz"))


def _timed_log(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").cast("string").alias("host"), (F.unix_micros("ts").cast("double") / 1e6).alias("ts"), (F.col("event_type") != "error").alias("ok"))


@scenario("stream_breaker", f"{_BREAKER} SELECT host, round(ts, 3) AS ts, allowed, state FROM b")
def _breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda e: incremental.breaker_stream(_timed_log(e), 2, 3600.0), rocks=True).withColumn("ts", F.round("ts", 3))


@scenario("stream_bucket", f"{_BUCKET} SELECT host, round(ts, 3) AS ts, round(waited, 2) AS waited FROM b")
def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda e: incremental.bucket_stream(_timed_log(e).drop("ok"), 0.001), rocks=True).select("host", F.round("ts", 3).alias("ts"), F.round("waited", 2).alias("waited"))


# projections, counters, functions ------------------------------------------------------------

_CUT = [c for c in filters.SUMMARY if c not in ("tags", "salary_currency", "last_seen_at", "posted_at", "first_seen_at")]
query("project_summary", "orders", f"SELECT {', '.join(_CUT)} FROM {LISTINGS}")(lambda t: conform(listings(t), JOB_ITEMS).select(*filters.SUMMARY).select(*_CUT))
query("project_detail", "orders", f"SELECT {', '.join(_CUT)}, external_id, CAST(NULL AS BIGINT) AS run_id FROM {LISTINGS}")(lambda t: conform(listings(t), JOB_ITEMS).select(*filters.DETAIL).select(*_CUT, "external_id", "run_id"))
query("count_filtered", "orders", f"SELECT count(*) AS n FROM {LISTINGS} WHERE is_active AND salary_max IS NOT NULL AND location ILIKE '%low%'")(lambda t: listings(t).where(filters.ItemFilters(has_salary=True, location="low").predicate()).agg(F.count("*").alias("n")))
query("item_to_row", "orders", """SELECT CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority || ' ' || o_custkey || ' Oslo x y' AS search_text, true AS is_active, CAST(5 AS BIGINT) AS run_id, '2026-03-01' AS seen,
    sha256(concat_ws(chr(31), o_orderpriority, CAST(o_custkey AS VARCHAR), 'Oslo', 'false', chr(0), CAST(CAST(round(o_totalprice, 2) AS DECIMAL(20, 2)) AS VARCHAR), chr(0), chr(0), chr(0), 'x' || chr(30) || 'y')) AS content_hash FROM orders""")(
    lambda t: merge.to_rows(t.select(F.lit("s").alias("source"), F.col("o_orderkey").cast("string").alias("external_id"), F.lit("u").alias("url"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").cast("string").alias("company"), F.lit("Oslo").alias("location"), F.lit(False).alias("remote"), F.lit(None).cast("string").alias("employment_type"), F.col("o_totalprice").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"), F.lit(None).cast("string").alias("salary_currency"), F.lit(None).cast("string").alias("description"), F.array(F.lit("x"), F.lit("y")).alias("tags")), DAYS[0], 5)
    .select("external_id", "search_text", "is_active", "run_id", F.date_format("first_seen_at", "yyyy-MM-dd").alias("seen"), "content_hash")
)


def _totals(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return events.select(F.col("event_type").alias("adapter"), (k % 7).alias("pages_fetched"), (k % 3).alias("retries"), (k % 11).alias("items_seen"), (k % 2).alias("failures"), (k % 5).alias("items_new"), (k % 4).alias("items_changed"), (k % 6).alias("items_unchanged"), (k % 9).alias("max_depth_reached"), F.col("value").alias("duration_seconds"), F.format_string('{"write_seconds": %s}', (F.col("value") / 100).cast("string")).alias("detail"))


_SUMS = {"pages_fetched_total": "sum(event_id % 7)", "retries_total": "sum(event_id % 3)", "items_seen_total": "sum(event_id % 11)", "failures_total": "sum(event_id % 2)", "items_new_total": "sum(event_id % 5)", "items_changed_total": "sum(event_id % 4)", "items_unchanged_total": "sum(event_id % 6)", "crawl_depth": "max(event_id % 9)"}
query("metric_lines", "events", "SELECT 'listings_' || name || '{adapter=\"' || adapter || '\"} ' || n AS line FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, event_type AS adapter, CAST({x} AS BIGINT) AS n FROM events GROUP BY 2" for n, x in _SUMS.items()) + ")")(lambda t: metrics.exposition(metrics.counters(_totals(t))))
_BOUNDS = lambda bounds: "[" + ", ".join(repr(b) for b in bounds) + "]"
query("run_histograms", "events", " UNION ALL ".join(
    f"SELECT '{name}' AS metric, event_type AS adapter, CASE WHEN b = 1e300 THEN '+Inf' ELSE CAST(b AS VARCHAR) END AS le, count(*) FILTER (v <= b) AS n, count(*) AS count FROM (SELECT event_type, {v} AS v, unnest(CAST({_BOUNDS([*bounds, 1e300])} AS DOUBLE[])) AS b FROM events WHERE value IS NOT NULL) GROUP BY event_type, b"
    for name, v, bounds in (("run_duration_seconds", "value", metrics.DURATION), ("db_write_seconds", "value / 100", metrics.WRITE))))(lambda t: metrics.run_histograms(_totals(t)))
query("wait_histogram", "events", f"SELECT CASE WHEN b = 1e300 THEN '+Inf' ELSE CAST(b AS VARCHAR) END AS le, count(*) FILTER (v <= b) AS n, count(*) AS count FROM (SELECT value / 50 AS v, unnest(CAST({_BOUNDS([*metrics.WAIT, 1e300])} AS DOUBLE[])) AS b FROM events WHERE value IS NOT NULL) GROUP BY b")(
    lambda t: metrics.wait_histogram(t.select((F.col("value") / 50).alias("waited"))).select("le", "n", "count")
)
query("run_summary_frame", "events", "SELECT event_id AS id, event_type AS adapter, CAST(event_id % 7 AS BIGINT) AS pages_fetched FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")(
    lambda t: rollups.recent_runs(t.select(F.col("event_id").alias("id"), F.col("event_type").alias("adapter"), F.col("ts").alias("started_at"), (F.col("event_id") % 7).cast("long").alias("pages_fetched"))).select("id", "adapter", "pages_fetched")
)
query("parse_money_first", "orders", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 900 + 10 AS DOUBLE) * 1000 WHEN 1 THEN CAST(o_orderkey % 90 AS DOUBLE) END AS amount FROM orders")(
    lambda t: t.select("o_orderkey", text.parse_money(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("from $"), (F.col("o_orderkey") % 900 + 10).cast("string"), F.lit("k to $999k"))).when(F.col("o_orderkey") % 3 == 1, F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(" EUR"))).otherwise("none")).alias("amount"))
)
query("posted_from_epoch", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2000-01-01 00:00:00' + INTERVAL 1 SECOND * (o_orderkey % 100000) ELSE date_trunc('day', o_orderdate) END AS at FROM orders")(
    lambda t: t.select("o_orderkey", text.posted_from_epoch(F.when(F.col("o_orderkey") % 2 == 0, F.lit(946684800) + F.col("o_orderkey") % 100000), F.date_format("o_orderdate", "yyyy-MM-dd")).cast("timestamp_ntz").alias("at"))
)
query("is_posting", "part", "SELECT p_partkey, p_partkey % 4 > 1 AS posting FROM part")(
    lambda t: t.select("p_partkey", text.is_posting(F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(": we're not hiring"))).when(F.col("p_partkey") % 4 == 1, "Position CLOSED now").when(F.col("p_partkey") % 4 == 2, "p_name")).alias("posting"))
)
query("scrub_known", "orders", "SELECT o_orderkey, 'Mail [redacted] or [redacted], ref [redacted], order ' || (o_orderkey % 1000) || ' of 2026-02-11, see https://x.example/a/' || o_orderkey || ' now' AS t FROM orders")(
    lambda t: t.select("o_orderkey", text.scrub_pii(F.format_string("Mail a%d@x%d.example or +1 (555) 123-%04d, ref 12345678%08d,\norder %d of 2026-02-11, see https://x.example/a/%d?q=%d&amp;r now", F.col("o_orderkey"), F.col("o_orderkey"), F.col("o_orderkey") % 10000, F.col("o_orderkey"), F.col("o_orderkey") % 1000, F.col("o_orderkey"), F.col("o_orderkey"))).alias("t"))
)
query("redact_phones_known", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'call [redacted].' WHEN o_orderkey % 3 = 1 THEN 'on 2026-02-11' ELSE 'just 12 34' END AS t FROM orders")(
    lambda t: t.select("o_orderkey", text.redact_phones(F.when(F.col("o_orderkey") % 3 == 0, F.format_string("call +49 30 %07d.", F.col("o_orderkey"))).when(F.col("o_orderkey") % 3 == 1, "on 2026-02-11").otherwise("just 12 34")).alias("t"))
)
query("collect_tags", "part", "SELECT p_partkey, array_to_string([p_type, 'R&D', p_brand, 'x y'], '|') AS tags FROM part")(
    lambda t: t.select("p_partkey", F.array_join(text.collect_tags(F.array(F.concat("p_type", F.lit(", R&D")), F.concat(F.lit(" ; "), "p_brand", F.lit(" | x  y")))), "|").alias("tags"))
)
query("clean_tags", "part", "SELECT p_partkey, p_brand || '|' || p_name AS tags FROM part")(
    lambda t: t.select("p_partkey", F.array_join(text.clean_tags(F.array(F.concat(F.lit("  "), "p_brand"), F.lit(" "), "p_name", "p_brand", F.concat("p_name", F.lit(" ")))), "|").alias("tags"))
)
query("redact_credentials", "part", "SELECT p_partkey, 'postgresql://***@h/db' || p_partkey AS url FROM part")(lambda t: t.select("p_partkey", urls.redact_credentials(F.concat(F.lit("postgresql://u"), F.col("p_partkey").cast("string"), F.lit(":p@h/db"), F.col("p_partkey").cast("string"))).alias("url")))
_JSON = """'{"company":"' || p_brand || '","description":"","employment_type":"' || p_type || '","location":null,"remote":' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || ',"salary_currency":"EUR","salary_max":null,"salary_min":' || CAST(p_retailprice AS VARCHAR) || ',"tags":["' || array_to_string(list_sort(string_split(p_type, ' ')), '","') || '"],"title":"' || p_name || '"}'"""
ORACLE["content_hash_compat"] = f"SELECT p_partkey, sha256({_JSON}) AS content_hash FROM part"
_DECODED = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_BARE = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g')"
ORACLE["normalise_text"] = f"SELECT page_id, trim(regexp_replace({_DECODED.format(_BARE)}, '\\s+', ' ', 'g')) AS t FROM pages"
_TEXT = _DECODED.format(f"regexp_replace(regexp_replace(regexp_replace({_BARE}, '(?i)</(p|div|li|tr|h[1-6]|br)\\s*/?>', chr(10), 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g')")
ORACLE["html_to_text"] = f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_TEXT}, chr(10)), lambda x: trim(regexp_replace({_DECODED.format('x')}, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM pages"
ORACLE["absolute_url"] = r"""SELECT page_id, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || href WHEN regexp_matches(href, '^https?://') THEN href END AS link
    FROM (SELECT page_id, url, unnest(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: x <> '')) AS href FROM pages)"""
query("is_html", "pages", "SELECT page_id, true AS html, sha256(coalesce(html, '')) AS page_hash FROM pages")(lambda t: t.select("page_id", _is_html(t).alias("html"), hashing.page_hash(F.col("html")).alias("page_hash")))


def _is_html(pages: DataFrame):
    from lodestack.sources.archive import is_html

    return is_html(F.create_map(F.lit("content-type"), F.lit("Text/HTML; charset=utf-8")))
