"""What only tables beyond the driver's small ones show, on small copies of them."""

from dataclasses import asdict
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestack.config import Settings
from lodestack.errors import ConfigError
from lodestack.operators import frontier
from lodestack.plans.pipeline import Store, crawl
from lodestack.sources import recorded
from lodestack.sources.adapters import BoardAdapter
from lodestack.sources.board_config import BoardConfig


def same_as_sql(spark, sf_dir, name, *tables):
    """The query's rows equal those of its SQL over the folder's tables."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet/*.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = __spark_entry__.queries()[name](spark, sf_dir)
    assert got.columns == names
    rows = want.fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows)) and rows
    return rows


def test_part_keys_may_be_those_of_threads(spark, sf, tmp_path):
    """Keys around half a million, where the threads' ids were: a part and a thread answered to one url."""
    part = spark.read.parquet(f"{sf}/part.parquet").limit(40).withColumn("p_partkey", F.monotonically_increasing_id() % 1000 + 499_990)
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    same_as_sql(spark, str(tmp_path), "thread_crawl_items", "part")


def test_a_board_of_more_than_a_hundred_index_pages(spark, tmp_path):
    """104 index pages of three parts each, one of which is missing as a page."""
    keys = [k * 1000 + j for k in range(104) for j in (0, 1, 49)]
    rows = [(k, f"part {k}", f"Brand#{k % 9}", f"KIND {k % 4}", k % 50 + 1, 900.0 + k % 7) for k in keys]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size long, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("board_crawl_counters", "board_crawl_items", "board_crawl_changes", "board_crawl_errors", "board_archive", "listing_frame", "run_detail_frame", "run_orphans"):
        rows = same_as_sql(spark, str(tmp_path), name, "part")
        assert name != "board_archive" or ("list", 1000, 208, 104) in rows


SITE = "https://b.example"
# Page 4 is first met as the detail of a card on page 2, so the index ends there; page 3 has a card of page 1 again.
LISTS = {
    "/l1": (["/d1", "/d2", "/d1#x", "https://away.example/d"], "/l2#top"), "/l2": (["/d3", "/l4", "/none"], "/l3"),
    "/l3": (["/d1", "/d4"], "/l4"), "/l4": (["/d5"], "/l1"), "/r1": (["/d1", "/d2"], "/r2"), "/r2": (["/d3"], "/r3"), "/r3": (["/d4", "/d2"], "/r1"), "/o1": (["/d1"], "https://away.example/l"),
}


def _site(spark):
    lists = [(SITE + u, "".join(f'<div class=card><h2>T</h2><a class=open href="{c}">go</a></div>' for c in cards) + f'<a class=next href="{more}">more</a>') for u, (cards, more) in LISTS.items()]
    return spark.createDataFrame(lists + [(f"{SITE}/d{k}", f"<h1>Job {k}</h1><b>Firm</b>") for k in range(1, 6)], "url string, text string")


@pytest.mark.parametrize(("start", "settings"), [("/l1", Settings(max_depth=9)), ("/r1", Settings(max_depth=9)), ("/r1", Settings(max_depth=1)), ("/r1", Settings(max_depth=9, max_pages=4)), ("/o1", Settings(max_depth=9))])
def test_looking_ahead_says_what_level_by_level_says(spark, tmp_path, start, settings):
    config = BoardConfig.from_mapping({"name": "b", "start_urls": [SITE + start], "list": {"item_selector": "div.card", "url": "a.open::attr(href)", "fields": {"title": "h2::text"}}, "detail": {"fields": {"title": "h1::text", "company": "b::text"}}, "pagination": {"max_pages": None, "next_selector": "a.next"}})
    adapter, known, said = BoardAdapter(config), recorded.Recorded(_site(spark)), []
    for name, fetch in (("levels", lambda f: known(f)), ("ahead", known)):
        store = Store(spark, str(tmp_path / name))
        run = asdict(crawl(store, adapter, fetch, datetime(2026, 3, 1), settings))
        run["detail"].pop("write_seconds", None)
        run.pop("duration_seconds")
        pages = store.read("raw_pages").select("url", "kind", "meta").collect()
        said.append((run, sorted(map(tuple, pages)), sorted(tuple(r) for r in store.read("job_items").select("url", "title").collect()), sorted(r.url for r in store.read("fetch_errors").collect())))
    assert said[0] == said[1] and said[0][0]["status"] == "succeeded" and said[0][0]["pages_fetched"] > 0


def test_chains_of_any_length(spark):
    links = spark.createDataFrame([(str(k), str(k + 1)) for k in range(37)] + [("37", "20"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("0",)], "node string")
    for most in (0, 1, 12, 100):
        got = frontier.chain(links, seeds, most, lambda df, _: df.localCheckpoint())
        assert {(r.node, r.depth) for r in got.collect()} == {(str(k), k) for k in range(min(most, 37) + 1)}


def test_open_pagination_needs_links():
    for bad in ({"max_pages": None}, {"max_pages": None, "next_selector": "a", "page_query_param": "p"}, {"max_pages": 101, "next_selector": "a"}):
        with pytest.raises(ConfigError):
            BoardConfig.from_mapping({"name": "b", "start_urls": ["http://x/"], "list": {"item_selector": "div", "url": "a::attr(href)"}, "pagination": bad})
