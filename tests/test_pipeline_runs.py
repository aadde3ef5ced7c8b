import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestack import cli
from lodestack.config import Settings
from lodestack.errors import ConfigError, LodestackError
from lodestack.plans.pipeline import Store, crawl, reparse
from lodestack.schemas import JOB_ITEMS, drift, orphans, repeated_keys
from lodestack.sources import adapters, archive, recorded
from lodestack.sources.tables import Table
from tests import fixture_board

DAY1, DAY2, DAY3 = datetime(2026, 3, 1), datetime(2026, 3, 2), datetime(2026, 3, 3)


@pytest.fixture(scope="module")
def board(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("board")
    return adapters.get_adapter("fixture", spark=spark, root=fixture_board.write(root))


def fetch_of(adapter):
    return lambda follows: recorded.answer(follows, adapter.recorded())


def test_crawl_recrawl_change_and_reparse(spark, board, tmp_path):
    store = Store(spark, str(tmp_path))
    r = crawl(store, board, fetch_of(board), DAY1)
    # pages: 2 lists, details 1, 2 and 4; 3 is not recorded, other.example is off site; 4 falls back to its list card
    assert (r.pages_fetched, r.failures, r.items_seen, r.items_new, r.status) == (5, 1, 3, 3, "succeeded")
    assert {x.url for x in store.read("fetch_errors").collect()} == {"https://harbour.example/jobs/3"}
    assert r.errors == ["HTTP 404 for https://harbour.example/jobs/3"] and r.detail["duplicates_skipped"] == 1
    items = {x.url.rsplit("/", 1)[1]: x for x in store.read("job_items").collect()}
    one, two, four = items["1"], items["2"], items["4#top"]
    assert (one.title, one.company, one.location, one.employment_type, one.salary_min, one.salary_max, one.salary_currency) == ("Harbour Pilot", "North & Co", "Oslo", "full-time", 85000.0, 105000.0, "EUR")
    assert one.description == "Steer ships. Mail [redacted] or [redacted]." and one.tags == ["Boats", "Radar"] and one.posted_at == datetime(2026, 3, 1) and not one.remote
    assert (two.remote, two.employment_type, two.salary_max, two.tags, two.location) == (True, "contract", 60000.0, ["remote"], "Remote (EU)")
    assert two.description == "Cook <well>. Contract work." and four.title == "Diver" and "description" not in json.loads(one.raw)
    assert drift(store.read("job_items"), JOB_ITEMS) == [] and repeated_keys(store.read("job_items"), ["source", "external_id"]).count() == 0
    assert orphans(store.read("job_items"), "run_id", store.read("crawl_runs")).count() == 0 and orphans(store.read("fetch_errors"), "run_id", store.read("crawl_runs")).count() == 0

    again = crawl(store, board, fetch_of(board), DAY2)
    assert (again.items_new, again.items_changed, again.items_unchanged, again.detail["marked_inactive"]) == (0, 0, 3, 0)
    assert store.read("job_items").where(F.col("last_seen_at") > DAY1).count() == 0  # unchanged rows are not touched

    replay = reparse(store, board, DAY3)
    assert (replay.items_seen, replay.items_unchanged) == (3, 3)
    board.bundle.override("https://harbour.example/jobs/1", fixture_board.DETAIL["/jobs/1"].replace("Pilot", "Master"))
    board.bundle.override("https://harbour.example/jobs?page=2", "<p>gone</p>")
    third = crawl(store, board, fetch_of(board), DAY3)
    assert (third.items_changed, third.items_unchanged, third.detail["marked_inactive"]) == (1, 1, 1)
    rows = {x.title: x for x in store.read("job_items").collect()}
    assert rows["Harbour Master"].first_seen_at == DAY1 and rows["Harbour Master"].last_seen_at == DAY3 and not rows["Diver"].is_active and len(rows) == 3
    assert rows["Harbour Master"].id == one.id
    board.bundle.overrides.clear()
    runs = store.read("crawl_runs").orderBy("id").collect()
    assert [x.status for x in runs] == ["succeeded"] * 4 and runs[0].items_new == 3 and runs[0].failures == 1
    assert archive.latest(store.read("raw_pages")).count() == 5 and archive.prune(store.read("raw_pages")).count() == 5
    store.clear_errors(1)
    assert store.read("fetch_errors").where("run_id = 1").count() == 0


def test_depth_and_page_budget(spark, board, tmp_path):
    r = crawl(Store(spark, str(tmp_path / "a")), board, fetch_of(board), DAY1, Settings(max_depth=0))
    assert r.pages_fetched == 1 and r.items_seen == 0 and r.detail["too_deep_skipped"] > 0
    r = crawl(Store(spark, str(tmp_path / "b")), board, fetch_of(board), DAY1, max_pages=3)
    assert r.requests_made == 3 and r.detail["over_budget"] > 0


def test_reparse_can_keep_one_item_a_page(spark, board, tmp_path):
    store = Store(spark, str(tmp_path))
    crawl(store, board, fetch_of(board), DAY1)
    assert reparse(store, board, DAY2, first_only=True).items_seen == 3


def test_empty_archive_flags_nothing(spark, board, tmp_path):
    r = reparse(Store(spark, str(tmp_path)), board, DAY1)
    assert (r.status, r.items_seen) == ("succeeded", 0)


def test_a_page_that_breaks_the_parser_is_one_failure(spark, board, tmp_path, monkeypatch):
    from lodestack.operators import board as pages

    out = pages.parse_page("list", 5, None, board.config)
    assert out["error"].startswith("TypeError") and out["details"] == []
    real = pages.parse_pages

    def broken(kind, markup, base, config):
        found = real(kind, markup, base, config)
        return F.when(kind == "detail", found.withField("error", F.lit("boom"))).otherwise(found)

    monkeypatch.setattr(pages, "parse_pages", broken)
    r = crawl(Store(spark, str(tmp_path)), board, fetch_of(board), DAY1)
    assert r.status == "succeeded" and r.failures == 4 and r.items_seen == 0 and "boom" in r.errors


def test_list_only_board(spark, board):
    config = adapters.BoardConfig.from_mapping({"name": "flat", "start_urls": ["https://h.example/"], "list": {"item_selector": "div.card", "url": "a.open::attr(href)", "fields": {"title": "h2::text", "company": "span.firm::text"}}})
    a = adapters.get_adapter("htmlboard", config=config)
    pages = spark.createDataFrame([("https://h.example/", "list", "https://h.example/", 1, 0, None, fixture_board.LIST1)], a.FOLLOW + ", text string")
    pages = a.parsed(pages)
    assert sorted(r.title for r in a.items(pages).collect()) == ["Cook", "Elsewhere", "Ghost", "Pilot"]
    assert a.follows(pages).count() == 0


def test_tables_publish_whole_versions(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), JOB_ITEMS)
    assert t.read().count() == 0
    df = spark.createDataFrame([(1, "s", "x")], "id long, source string, external_id string")
    t.publish(df)
    old = t.read()
    t.append(df)
    assert (old.count(), t.read().count(), len(t.segments())) == (1, 2, 2)
    t.compact()
    assert len(t.segments()) == 1 and t.read().count() == 2 and t.vacuum() == 2 and t.read().count() == 2
    with t.lock(), pytest.raises(LodestackError), t.lock():
        pass
    with t.lock():
        pass
    with pytest.raises(LodestackError):
        t.replace(df, ["s"])


def test_partitions_are_replaced_alone(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), JOB_ITEMS, "source")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, source string, external_id string")
    t.publish(rows((1, "a/b=c", "x"), (2, "z", "y"), (3, "z", "w")))
    kept = [s for s in t.segments() if s.endswith("=z")]
    t.replace(rows((1, "a/b=c", "x2"), (4, "new", "n")), ["a/b=c", "new"])
    assert {(r.id, r.source, r.external_id) for r in t.read().collect()} == {(1, "a/b=c", "x2"), (2, "z", "y"), (3, "z", "w"), (4, "new", "n")}
    assert kept[0] in t.segments() and len(t.segments()) == 3
    assert {r.id for r in t.read(["a/b=c"]).collect()} == {1} and t.read(["nope"]).count() == 0
    assert t.vacuum() == 0 and t.read().count() == 4


def test_a_merge_touches_its_source_only(spark, tmp_path):
    from tests.test_queries import batch

    store = Store(spark, str(tmp_path))
    give = lambda *rows: batch(spark, *rows).selectExpr("*", "cast(null as string) raw", "cast(null as timestamp) posted_at")
    store.upsert(give(("a", "1", "u", "T1"), ("b", "1", "u", "T2")), DAY1, 1)
    before = {s for s in store.tables["job_items"].segments() if s.endswith("source=b")}
    stats, flagged = store.upsert(give(("a", "2", "u", "T3")), DAY2, 2, "a")
    assert stats["new"] == 1 and flagged == 1 and before <= set(store.tables["job_items"].segments())
    rows = {(r.source, r.external_id): (r.id, r.is_active) for r in store.read("job_items").collect()}
    assert rows["a", "1"][1] is False and rows["b", "1"][1] is True and rows["a", "2"][0] == 3 and len({i for i, _ in rows.values()}) == 3


def test_bundle_errors_and_recorder(spark, board, tmp_path):
    with pytest.raises(ConfigError):
        recorded.FixtureBundle(spark, str(tmp_path / "none"))
    n = recorded.record(board.bundle.pages(), str(tmp_path / "out"), fixture_board.CONFIG)
    copy = adapters.get_adapter("fixture", spark=spark, root=str(tmp_path / "out"))
    assert n == 5 and {tuple(r) for r in copy.recorded().collect()} == {tuple(r) for r in board.recorded().collect()}
    with pytest.raises(ConfigError):
        adapters.get_adapter("nope")
    asked = spark.createDataFrame([("http://x/a?b=1", "json")], "url string, kind string")
    known = spark.createDataFrame([("http://x/a", "{}")], "url string, text string")
    assert recorded.answer(asked, known, True).first().text == "{}" and recorded.answer(asked, known).first().status_code == 404


def test_archive(spark):
    raw = spark.createDataFrame([("u", 200, "é" * 10, {"Content-Type": "text/HTML", "Set-Cookie": "k"}, DAY1, "list"), ("u", 200, "b", {}, DAY2, "list"), ("v", 200, "x" * 50, None, DAY1, "list")], "url string, status_code int, text string, headers map<string,string>, fetched_at timestamp, kind string")
    pages = archive.build_pages(raw)
    assert pages.where(archive.is_html(F.col("headers"))).count() == 3
    rows = archive.archive_rows(pages, "a", 40).withColumn("id", F.monotonically_increasing_id())
    assert rows.count() == 2 and archive.too_large(pages, 40).count() == 1
    assert {k for r in rows.collect() for k in r.headers} == {"content-type"}
    assert {r.text for r in archive.replayed(rows).collect()} == {"é" * 10, "b"}
    assert [r.url for r in archive.urls(rows).collect()] == ["u"] and archive.latest(rows).first().fetched_at == DAY2
    with pytest.raises(ConfigError):
        archive.prune(rows, 0)


def test_cli(spark, board, tmp_path):
    said = []
    run = lambda *a: cli.main(["--store", str(tmp_path), *a], spark, said.append)
    assert run("crawl", board.bundle.root) == 0 and "3 new" in said[0] and json.loads(said[1])["items_new"] == 3
    assert run("reparse", board.bundle.root) == 0 and run("stats") == 0 and run("runs") == 0 and run("adapters") == 0
    assert run("crawl", "live.yml") == 2 and run("crawl", str(tmp_path / "no")) == 1 and run("nonsense") == 2


def test_settings():
    assert Settings(log_level="debug").log_level == "DEBUG" and Settings().sync_database_url == "postgresql://localhost/listings"
    for bad in ({"max_pages": 0}, {"user_agent": " "}, {"log_level": "loud"}, {"requests_per_second": 0}, {"nope": 1}):
        with pytest.raises(ConfigError):
            Settings.from_mapping(bad)
