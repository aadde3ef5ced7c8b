from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestack.errors import ConfigError
from lodestack.operators import filters as Q
from lodestack.operators import merge, metrics, rollups
from lodestack.schemas import JOB_ITEMS, conform

D = [datetime(2026, 1, d) for d in range(1, 29)]


@pytest.fixture(scope="module")
def items(spark):
    rows = []
    for i in range(1, 15):
        posted = None if i % 5 == 0 else D[i % 7]
        rows.append((i, "a" if i % 2 else "b", str(i), f"Engineer {i}" if i % 3 else "C++ Writer", f"Co{i % 4}", "Berlin" if i % 2 else None, i % 3 == 0, "full-time" if i % 2 else None, 10.0 * i if i % 4 else None, 20.0 * i if i % 4 else None, posted, D[i], i != 14, f"Engineer number{i} Node.js Berlin" if i % 3 else "C++ writer"))
    cols = "id long, source string, external_id string, title string, company string, location string, remote boolean, employment_type string, salary_min double, salary_max double, posted_at timestamp, first_seen_at timestamp, is_active boolean, search_text string"
    return conform(spark.createDataFrame(rows, cols), JOB_ITEMS).cache()


def ids(items, **kw):
    return {r.id for r in items.where(Q.ItemFilters(**kw).predicate()).collect()}


def test_filters(items):
    every = set(range(1, 15))
    assert ids(items) == every - {14} and ids(items, is_active=False) == every and ids(items, is_active=None) == every
    assert ids(items, companies=("Co1", "Co2")) == {i for i in every - {14} if i % 4 in (1, 2)}
    assert ids(items, location="berl") == {i for i in every if i % 2} and ids(items, remote=False) == {i for i in every - {14} if i % 3}
    assert ids(items, employment_type="full-time", source="a") == {i for i in every if i % 2}
    assert ids(items, posted_after=D[6]) == {6, 13} and ids(items, has_salary=False) == {4, 8, 12} and ids(items, min_salary=200.0) == {10, 11, 13}
    for bad in ({"sort": "title"}, {"limit": 0}, {"limit": 201}, {"min_salary": -1.0}):
        with pytest.raises(ConfigError):
            Q.ItemFilters(**bad)


def test_search(items):
    assert ids(items, q="node js") == {i for i in range(1, 14) if i % 3} and ids(items, q="number7 BERLIN") == {7} and ids(items, q="berli") == set() and ids(items, q="!!") == set()
    assert ids(items, q=" berli ", q_mode="substring") == {i for i in range(1, 14) if i % 3} and ids(items, q="c++", q_mode="substring") == {3, 6, 9, 12}
    stored = Q.with_tokens(items)
    assert {r.id for r in stored.where(Q.search_indexed("node js", F.col("tokens"))).collect()} == {i for i in range(1, 15) if i % 3}
    assert Q.inverted_index(items).where("token = 'number7'").first().id == 7


@pytest.mark.parametrize("sort,descending,limit", [("posted_at", True, 3), ("posted_at", False, 4), ("company", True, 2), ("first_seen_at", False, 5)])
def test_keyset_walk_meets_each_row_once(items, sort, descending, limit):
    seen, cursor = [], None
    while True:
        f = Q.ItemFilters(is_active=None, sort=sort, descending=descending, limit=limit, cursor=cursor)
        rows, cursor = Q.page(items, f)
        seen += [r.id for r in rows]
        if cursor is None:
            break
    assert seen == [r.id for r in Q.ordered(items, sort, descending).collect()] and len(set(seen)) == 14


def test_cursors():
    for value, row in ((D[3], 42), (None, 7)):
        cursor = Q.encode_cursor(value, row)
        back = Q.decode_cursor(cursor)
        assert back[1] == row and (back[0].replace(tzinfo=None) if back[0] else None) == value and "=" not in cursor
    assert Q.decode_cursor(Q.encode_cursor("2026-01-01", 3), "company") == ("2026-01-01", 3)
    assert [Q.decode_cursor(x) for x in ("!!!", "", "YWJj", "é")] == [None] * 4


def test_cursor_column_and_plain_predicate(spark, items):
    df = spark.createDataFrame([("2026-01-01T00:00:00+00:00", 9), (None, 7), ("?>~", 1)], "v string, k long")
    assert [r[0] for r in df.select(Q.cursor_column(F.col("v"), F.col("k"))).collect()] == [Q.encode_cursor(v, k) for v, k in (("2026-01-01T00:00:00+00:00", 9), (None, 7), ("?>~", 1))]
    assert items.where(Q.after_cursor("posted_at", None, 5, null_safe=False)).count() == 4
    assert items.where(Q.after_cursor("posted_at", D[6], 5, null_safe=False) & F.col("posted_at").isNull()).count() == 0


def test_page_plan_is_a_top_k_with_pushdown(spark, items, tmp_path):
    items.write.parquet(str(tmp_path / "t"))
    f = Q.ItemFilters(source="a", cursor=Q.encode_cursor("Co2", 3), sort="company")
    df = Q.list_items(spark.read.parquet(str(tmp_path / "t")), f).select(*Q.SUMMARY)
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "TakeOrderedAndProject" in plan and "EqualTo(source,a)" in plan and "LessThan(company,Co2)" in plan
    assert "description" not in plan.split("ReadSchema")[-1]


def test_projections(items):
    assert not {"search_text", "content_hash", "raw", "description"} & set(Q.SUMMARY) and Q.by_id(items, 3).count() == 1 and Q.by_id(items, 99).count() == 0


def test_rollups(spark, items):
    top = rollups.company_rollup(items).collect()
    assert [(r.company, r.n_items) for r in top] == [("Co1", 4), ("Co0", 3), ("Co2", 3), ("Co3", 3)]
    assert rollups.company_rollup(items, False).first().company == "Co2" and sum(r.n_items for r in rollups.company_rollup(items, None).collect()) == 14
    assert [tuple(r) for r in rollups.facet(items, "location").collect()] == [("Berlin", 7)]
    with pytest.raises(ConfigError):
        rollups.facet(items, "title")
    o = rollups.overview(items, D[15], 5).first()
    assert (o.total, o.active, o.remote, o.with_salary, o.new_recent) == (14, 13, 4, 11, 5)
    assert rollups.shares(rollups.overview(items, D[15])).first().remote_share == "31%" and rollups.shares(rollups.overview(items.limit(0), D[15])).first().salary_share == "—"
    assert rollups.source_map(items).first().by_source == {"a": 7, "b": 7}
    days = rollups.daily_series(items, "first_seen_at", datetime(2026, 1, 10, 12), 5).collect()
    assert [r.n for r in days] == [0, 1, 1, 1, 1] and len(days) == 5  # the first day counts from noon on


def test_runs_and_errors(spark):
    runs = spark.createDataFrame([(1, "x", "succeeded", D[1]), (2, "x", "failed", D[3]), (3, "x", "succeeded", D[2])], "id long, adapter string, status string, started_at timestamp")
    errors = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c")], "run_id long, error string")
    assert [r.id for r in rollups.recent_runs(runs, 2).collect()] == [2, 3] and rollups.latest_successful(runs).first().id == 3
    assert [(r.error, r.n) for r in rollups.failure_breakdown(errors, 1).collect()] == [("b", 2), ("a", 1)]
    assert [(e.error, e.n) for e in rollups.run_with_errors(runs, errors, 1).first().errors] == [("b", 2), ("a", 1)]


def test_metrics(spark):
    log = spark.createDataFrame([(200, 0.2, False, False, False, 10), (404, 7.0, True, False, False, 5), (None, 40.0, False, True, True, None)], "status_code int, seconds double, retried boolean, denied boolean, skipped boolean, bytes long")
    r = metrics.request_stats(log).first()
    assert (r.requests, r.retries, r.robots_denied, r.circuit_skips, r.bytes_downloaded, r.by_status) == (3, 1, 1, 1, 15, {"200": 1, "404": 1})
    assert rollups.status_histogram(log).count() == 3
    h = {x.le: x.n for x in metrics.histogram(log, "seconds", metrics.LATENCY).collect()}
    assert (h["0.1"], h["0.25"], h["10.0"], h["+Inf"]) == (0, 1, 2, 3)
    runs = spark.createDataFrame([('a"b', 3, 0, 2, 1, 1, 0, 1, 2)], "adapter string, pages_fetched int, retries int, items_seen int, failures int, items_new int, items_changed int, items_unchanged int, max_depth_reached int")
    lines = [x.line for x in metrics.exposition(metrics.counters(runs)).collect()]
    assert 'listings_pages_fetched_total{adapter="a\\"b"} 3' in lines and len(lines) == 8


def batch(spark, *rows):
    kinds = "source string, external_id string, url string, title string, company string, description string, tags array<string>, remote boolean"
    return spark.createDataFrame([(s, e, u, t, "Co", "text", ["x"], False) for s, e, u, t in rows], kinds).selectExpr("*", "cast(null as string) location", "cast(null as string) employment_type", "cast(null as double) salary_min", "cast(null as double) salary_max", "cast(null as string) salary_currency")


def test_merge_outcomes(spark):
    table = conform(spark.createDataFrame([], "id long"), JOB_ITEMS)
    one = merge.to_rows(batch(spark, ("a", "1", "u1", "T1"), ("a", "2", "u2", "T2"), ("b", "1", "u3", "T3")), D[1], 1)
    table = merge.merge(table, one).cache()
    assert sorted(r.id for r in table.collect()) == [1, 2, 3] and merge.write_stats(merge.classify(table, one)).first().asDict() == {"new": 0, "changed": 0, "unchanged": 3, "total": 3}
    two = merge.to_rows(batch(spark, ("a", "1", "moved", "T1"), ("a", "2", "u2", "T2!"), ("b", "9", "u9", "T9")), D[2], 2)
    s = merge.write_stats(merge.classify(table, two)).first()
    assert (s.new, s.changed, s.unchanged) == (1, 1, 1)
    rows = {(r.source, r.external_id): r for r in merge.merge(table, two).collect()}
    assert rows["a", "1"].url == "u1" and rows["a", "1"].run_id == 1 and rows["a", "1"].last_seen_at == D[1]
    assert rows["a", "2"].title == "T2!" and rows["a", "2"].first_seen_at == D[1] and rows["a", "2"].last_seen_at == D[2] and rows["a", "2"].run_id == 2
    assert rows["b", "9"].id == 4 and rows["b", "9"].first_seen_at == D[2] and len(rows) == 4
    touched = {(r.source, r.external_id): r for r in merge.merge(table, two, touch_unchanged=True).collect()}
    assert touched["a", "1"].last_seen_at == D[2] and touched["a", "1"].url == "u1"
    stale = merge.mark_stale(table, "a", spark.createDataFrame([("1",)], "external_id string"), 7)
    assert {(r.source, r.external_id): (r.is_active, r.run_id) for r in stale.collect()} == {("a", "1"): (True, 1), ("a", "2"): (False, 7), ("b", "1"): (True, 1)} and merge.stale_count(table, stale) == 1
    back = merge.merge(stale, one)
    assert not next(r for r in back.collect() if r.external_id == "2").is_active  # unchanged rows stay inactive
    assert merge.merge(stale, one, touch_unchanged=True).where("is_active").count() == 3
    assert merge.mark_stale(table, "a", spark.createDataFrame([], "external_id string")).where("is_active").count() == 1


def test_last_of_each(spark):
    df = batch(spark, ("a", "1", "u", "first"), ("a", "1", "u", "second")).withColumn("n", F.when(F.col("title") == "first", 1).otherwise(2))
    assert [r.title for r in merge.last_of_each(df, "n").collect()] == ["second"]
    assert merge.last_of_each(merge.to_rows(df.drop("n"), D[1])).count() == 1
