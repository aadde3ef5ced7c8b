import random

import pytest

from lodestack.errors import ConfigError
from lodestack.operators import frontier as T
from lodestack.operators import policy as P

keep = lambda df, label: df.cache()


def sequential(pushes, seen, max_depth, room):
    """What a queue says to pushes (url, depth), in order."""
    seen, out, queued = set(seen), [], 0
    for url, depth in pushes:
        canon = url.lower()
        if depth > max_depth:
            out.append("too_deep")
        elif queued >= room:
            out.append("over_budget")
        elif canon in seen:
            out.append("duplicate")
        else:
            seen.add(canon)
            queued += 1
            out.append("queued")
    return out


@pytest.mark.parametrize("room", [0, 1, 5, 1000])
def test_admit_as_a_queue_would(spark, room):
    rng = random.Random(room)
    pushes = [(f"http://H{rng.randint(0, 9)}.test", 3 if rng.random() < 0.1 else 1) for _ in range(60)]
    df = spark.createDataFrame([(u, d, f"{k:04d}") for k, (u, d) in enumerate(pushes)], "url string, depth int, seq string")
    seen = spark.createDataFrame([("http://h3.test",)], "canon string")
    got = T.admit(df, seen, 2, room)
    # a queue meets rows in the order of seq; deep ones have no part in the order of depth
    assert [r.verdict for r in got.orderBy("seq").collect()] == sequential(pushes, {"http://h3.test"}, 2, room)
    assert T.stats(got).queued == min(room, len({u for u, d in pushes if d <= 2} - {"http://H3.test"}))


def test_traverse_levels(spark):
    links = {"http://a/": ["http://a/1", "http://a/2"], "http://a/1": ["http://a/", "http://a/3"], "http://a/2": ["http://a/3"], "http://a/3": ["http://a/4"]}
    edges = spark.createDataFrame([(s, d, f"{s}{k}") for s, ds in links.items() for k, d in enumerate(ds)], "src string, dst string, seq string")
    seeds = spark.createDataFrame([("http://a/", "0")], "url string, seq string")
    expand = lambda level: level.selectExpr("url as src").join(edges, "src").selectExpr("dst as url", "seq")
    found, stats = T.traverse(seeds, expand, keep, max_depth=2)
    assert {(r.url, r.depth) for r in found.collect()} == {("http://a/", 0), ("http://a/1", 1), ("http://a/2", 1), ("http://a/3", 2)}
    assert (stats.queued, stats.duplicates, stats.too_deep, stats.max_depth_reached) == (4, 2, 1, 2)
    assert T.traverse(seeds, expand, keep, 2, max_items=2)[1].over_budget > 0
    graph = edges.selectExpr("src", "dst")
    reach = T.reachable(graph, seeds.selectExpr("url as node"), 3, keep)
    assert {(r.node, r.depth) for r in reach.collect()} == {("http://a/", 0), ("http://a/1", 1), ("http://a/2", 1), ("http://a/3", 2), ("http://a/4", 3)}


def test_on_site(spark):
    df = spark.createDataFrame([("http://x/1", "http://y", 0), ("http://x/1", "http://y", 1), ("http://b.y/1", "http://y", 1), ("http://z", None, 1)], "url string, base_url string, depth int")
    assert T.on_site(df).count() == 3


def test_breaker_machine():
    b = P.Breaker(3, 10.0)
    for t in (0, 1, 2):
        assert b.admits(t)
        b.record(False, t)
    assert b.state == "open" and not b.admits(5) and b.at(12) == "half_open"
    assert b.admits(12) and not b.admits(12.5)
    b.record(False, 13)
    assert b.state == "open" and not b.admits(20) and b.admits(23)
    b.record(True, 23)
    assert b.state == "closed" and b.failures == 0
    b.record(False, 24)
    b.record(True, 25)
    assert b.failures == 0
    with pytest.raises(ConfigError):
        P.Breaker(0)


def test_bucket_machine():
    b = P.Bucket(2.0, 2.0)
    assert sum(b.wait(0.0) for _ in range(5)) == pytest.approx(0.5 + 1.0 + 1.5)  # each asked at time zero
    b, now, waited = P.Bucket(2.0, 2.0), 0.0, 0.0
    for _ in range(5):
        w = b.wait(now)
        now, waited = now + w, waited + w
    assert waited == pytest.approx(1.5)
    with pytest.raises(ConfigError):
        b.wait(0, 3.0)
    with pytest.raises(ConfigError):
        P.Bucket(0)
    assert P.Bucket(0.5).capacity == 1.0


def test_replays(spark):
    rng = random.Random(4)
    log = [(f"h{rng.randint(0, 3)}", float(k), k, rng.random() < 0.4) for k in range(200)]
    df = spark.createDataFrame(log, "host string, ts double, seq int, ok boolean")
    got = {(r.host, r.seq): (r.allowed, r.state) for r in P.replay_breaker(df, 3, 20.0).collect()}
    machines = {}
    for host, ts, seq, ok in log:
        b = machines.setdefault(host, P.Breaker(3, 20.0))
        allowed = b.admits(ts)
        if allowed:
            b.record(ok, ts)
        assert got[host, seq] == (allowed, b.state)
    assert P.breaker_states(P.replay_breaker(df, 3, 20.0)).first().breakers == {h: b.state for h, b in machines.items()}
    waits = P.replay_bucket(df, 0.1).collect()
    assert len(waits) == 200 and min(r.waited for r in waits) == 0.0 and max(r.waited for r in waits) > 1


def test_retries(spark):
    df = spark.createDataFrame([(200,), (404,), (429,), (503,), (599,), (418,), (301,)], "s int")
    assert [r[0] for r in df.select(P.status_class(P.F.col("s"))).collect()] == ["ok", "fatal", "retry", "retry", "retry", "other", "ok"]
    rows = spark.range(10).select(P.backoff_ceiling(P.F.col("id")).alias("c"), P.backoff(P.F.col("id"), P.F.lit("h")).alias("b")).collect()
    assert [r.c for r in rows[:7]] == [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 30.0] and all(0 <= r.b <= r.c for r in rows)


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nCrawl-delay: 3\n"
    urls = spark.createDataFrame([("http://a.com/x",), ("http://a.com/private/1",), ("http://b.com/",), ("http://c.com/",), ("http://d.com/",)], "url string")
    answers = spark.createDataFrame([("a.com", 200, body), ("b.com", 404, None), ("c.com", 503, None)], "host string, status int, body string")
    got = {r.url: (r.verdict.allowed, r.verdict.crawl_delay) for r in P.check_robots(urls, answers, "bot", 1.0).collect()}
    assert got == {"http://a.com/x": (True, 3.0), "http://a.com/private/1": (False, None), "http://b.com/": (True, 1.0), "http://c.com/": (False, None), "http://d.com/": (False, None)}
