from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestack.config import Settings, request_params
from lodestack.plans import service
from lodestack.plans.pipeline import RunResult, Store
from lodestack.sources import http
from tests.test_queries import batch


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    run = store.start_run("x", datetime(2026, 1, 1))
    rows = batch(spark, ("a", "1", "u1", "T1"), ("a", "2", "u2", "T2"), ("b", "3", "u3", "T3")).selectExpr("*", "cast(null as string) raw", "timestamp'2026-01-01' posted_at")
    store.upsert(rows, datetime(2026, 1, 1), run)
    store.record_errors(run, spark.createDataFrame([("u", "m" * 3000), ("v", "n")], "url string, error string"), datetime(2026, 1, 1))
    store.finish_run(run, RunResult("x", "succeeded", pages_fetched=3, items_seen=3, items_new=3), datetime(2026, 1, 1))
    return service.Service(store)


def test_questions(site):
    rows, cursor = site.items(limit=2)
    more, end = site.items(limit=2, cursor=cursor)
    newest = [r.title for r in site.store.read("job_items").orderBy(F.desc("id")).collect()]
    assert [r.title for r in rows + more] == newest and end is None and "description" not in rows[0].asDict()
    assert site.item(1).first().title == newest[-1] and site.companies().first().n_items == 3 and site.companies(include_inactive=True).count() == 0
    assert site.facets("source").count() == 2 and site.ready().first().id == 1 and site.runs().count() == 1
    s = site.stats(datetime(2026, 1, 2))
    assert s["totals"].first().new_recent == 3 and s["by_source"].first().by_source == {"a": 2, "b": 1} and s["daily"].count() == 30
    run = site.run(1).first()
    assert sorted(len(e.error) for e in run.errors) == [1, 2000] and run.detail == "{}"
    assert 'listings_items_new_total{adapter="x"} 3' in [r.line for r in site.metrics().collect()]
    for missing in (site.item, site.run):
        with pytest.raises(service.NotFound):
            missing(99)


def test_frames(spark, site):
    items = site.store.read("job_items")
    row = service.listing_frame(items).first()
    assert (row.Location, row.Remote, row.Salary, row.Posted) == ("—", "no", "—", "2026-01-01")
    assert service.company_frame(site.companies()).columns[0] == "Company" and service.run_frame(site.runs()).first().seconds == 0.0
    df = spark.createDataFrame([('{"id": 1, "posted_at": "2026-02-11T09:30:00Z"}',), ('{"id": 2, "posted_at": "soon"}',)], "v string")
    assert [r[0].posted_at for r in df.select(service.parse_listing(F.col("v"))).collect()] == [datetime(2026, 2, 11, 9, 30), None]
    assert request_params(a=None, b=[], c="", d=0, e=False, f="x") == {"d": 0, "e": False, "f": "x"}


def client(answers, **kw):
    now = [0.0]
    seen = []

    def get(url, timeout):
        seen.append(url)
        a = answers(url, len(seen))
        if isinstance(a, Exception):
            raise a
        return a

    def sleep(s):
        now[0] += s

    return http.HostClient(Settings(**kw), get, lambda: now[0], sleep), seen, now


def test_retries_and_waits():
    c, seen, now = client(lambda u, n: (503, "", {"retry-after": "7"}) if n < 3 else (200, "ok", {}), respect_robots=False, requests_per_second=10.0)
    assert c.get("http://a/x")[:4] == (200, "ok", {}, 2) and len(seen) == 3 and now[0] >= 14
    c, seen, _ = client(lambda u, n: (404, "", {}), respect_robots=False)
    assert c.get("http://a/x")[0] == 404 and len(seen) == 1
    c, seen, _ = client(lambda u, n: TimeoutError(), respect_robots=False, max_retries=1)
    assert c.get("http://a/x")[5] == "unreachable" and len(seen) == 2


def test_breaker_and_robots():
    c, seen, now = client(lambda u, n: (500, "", {}), respect_robots=False, breaker_threshold=2, max_retries=0, breaker_reset=1000.0)
    assert [c.get("http://a/x")[5] for _ in range(4)] == ["fetched", "fetched", "circuit_open", "circuit_open"] and len(seen) == 2
    c, seen, now = client(lambda u, n: (200, "User-agent: *\nDisallow: /no\nCrawl-delay: 5", {}))
    assert c.get("http://a/no/1")[5] == "disallowed_by_robots" and c.get("http://a/yes")[0] == 200 and seen == ["http://a/robots.txt", "http://a/yes"]
    for _ in range(3):
        c.get("http://a/yes")
    assert now[0] >= 10


def test_fetch_plan(spark):
    pages = {f"http://h{k % 3}/{k}": f"page {k}" for k in range(12)}
    df = spark.createDataFrame([(u, "x") for u in [*pages, "http://h0/none"]], "url string, kind string")
    rows = http.fetch(df, http.map_transport(pages), Settings(requests_per_second=1000.0), sleep=lambda s: None).collect()
    assert {r.url: r.text for r in rows if r.status_code == 200} == pages and sum(r.status_code == 404 for r in rows) == 1 and {r.reason for r in rows} == {"fetched"}
    denied = http.fetch(df, http.map_transport(pages, robots_status=503), Settings(), sleep=lambda s: None).collect()
    assert {r.reason for r in denied} == {"disallowed_by_robots"}


def test_retry_after_and_jitter():
    waits = []
    answers = iter([(503, "", {"retry-after": "Thu, 01 Jan 1970 00:00:09 GMT"}), (429, "x", {"retry-after": "2.5"}), (500, "", {}), (200, "ok", {})])
    c = http.HostClient(Settings(respect_robots=False, requests_per_second=1e6), lambda u, t: next(answers), lambda: 0.0, waits.append, lambda: 0.0)
    status, text, _, retries, waited, reason, requests, size, seen, state = c.get("http://q/1")
    assert (status, text, retries, reason, requests, size, seen, state) == (200, "ok", 3, "fetched", 4, 3, {"503": 1, "429": 1, "500": 1, "200": 1}, "closed")
    drawn = http.jitter("http://q/1", 2, 0.5, 30.0)
    assert [w for w in waits if w] == [9.0, 2.5, drawn] and 0 <= drawn <= 2.0 and sum(waits) == waited
    assert [http.retry_after(v, 0.0) for v in ("-3", "soon", None, "", "Wed, 31 Dec 1969 23:00:00 GMT")] == [0.0, None, None, None, 0.0]
    draws = [http.jitter(f"u{k}", 10, 0.5, 30.0) for k in range(500)]
    assert max(draws) <= 30 and 13 < sum(draws) / 500 < 17


def test_breaker_counts_pages_and_ignores_4xx():
    c, seen, _ = client(lambda u, n: (404, "", {}) if "no" in u else (500, "", {}), respect_robots=False, breaker_threshold=2, max_retries=1, breaker_reset=1000.0)
    assert [c.get(u)[5] for u in ("http://a/1", "http://a/no", "http://a/2", "http://a/3")] == ["fetched", "fetched", "fetched", "circuit_open"] and len(seen) == 5


def test_crawl_delay_and_threads_of_a_host():
    import threading
    import time
    from concurrent.futures import ThreadPoolExecutor

    c, seen, now = client(lambda u, n: (404, "", {}), crawl_delay=4.0)
    for k in range(3):
        c.get(f"http://a/{k}")
    assert now[0] == 8.0  # no robots.txt: the default delay
    most, running, lock = [0], [0], threading.Lock()

    def get(url, timeout):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.02)
        with lock:
            running[0] -= 1
        return 200, url, {}

    shared = http.HostClient(Settings(respect_robots=False, requests_per_second=1e6), get)
    with ThreadPoolExecutor(2) as pool:
        rows = list(pool.map(shared.get, [f"http://a/{k}" for k in range(12)]))
    assert [r[1] for r in rows] == [f"http://a/{k}" for k in range(12)] and most[0] == 2


def test_request_log_and_run_counters(spark, tmp_path):
    df = spark.createDataFrame([(f"http://h{k % 3}.test/{k}",) for k in range(12)] + [("http://down.test/1",), ("http://down.test/2",), ("http://down.test/3",)], "url string")

    def get(url, timeout):
        return (503, "", {}) if "down" in url else (404, "", {}) if url.endswith(("/robots.txt", "/5")) else (200, "four", {})

    s = Settings(requests_per_second=1e6, crawl_delay=0, max_retries=1, breaker_threshold=2, respect_robots=False)
    log = http.request_log(http.fetch(df, get, s, sleep=lambda x: None)).first()
    assert (log.requests, log.retries, log.failures, log.robots_denied, log.circuit_skips, log.bytes_downloaded) == (16, 2, 3, 0, 1, 44)
    assert log.statuses == {"200": 11, "404": 1, "503": 4} and log.breakers == {"down.test": "open"}
