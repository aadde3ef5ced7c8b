import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestack.operators import thread
from lodestack.plans.pipeline import Store, crawl, reparse
from lodestack.sources import adapters, recorded

ONE = "<p>North Co | Pilot | Oslo</p>\n<p>Location: Oslo, Norway | Remote | Full-time</p>\n<p>Salary: €85k - €105k</p>\n<p>We use Python and Kubernetes.</p>\n<p><a href='https://north.example/apply?x=1'>a</a> <a href='https://north.example/more'>b</a> mail me@north.example</p>"
TWO = "<p>Deep | Diver (Remote, EU)</p>\n<p><i>Quoted words in Go.</i></p>\n<p>$100k - $120k</p>"
CASES = {
    "not hiring": "<p>A | B</p>\n<p>we're not hiring</p>", "no role": "<p>Just talk</p>", "empty": "  ", "null": None,
    "late role": "\n".join(f"<p>l{k}</p>" for k in range(6)) + "\n<p>A1 | B</p>",
    "bare paragraphs": "Bare Co | Role<p>Remote<p>Text", "marker line": "<p>Co | Role</p>\n<p>Remote | Full-time</p>", "url": "<p>Co | Role</p>\nsee https://x.example/a?b=1 now",
}


def parsed(spark, comments):
    df = spark.createDataFrame([(k, v) for k, v in comments.items()], "k string, text string")
    return {r.k: r.posting for r in thread.parse_comments(df).collect()}


def test_postings(spark):
    got = parsed(spark, {"one": ONE, "two": TWO} | CASES)
    one, two = got["one"], got["two"]
    assert (one.company, one.role, one.location, one.remote, one.employment_type) == ("North Co", "Pilot | Oslo", "Oslo, Norway", True, "full-time")
    assert (one.salary_min, one.salary_max, one.salary_currency) == (85000.0, 105000.0, "EUR")
    assert one.description == "We use Python and Kubernetes. a b mail [redacted]" and one.links == ["https://north.example/apply", "https://north.example/more"]
    assert one.tags == ["remote", "full-time", "python", "kubernetes"]
    assert (two.role, two.remote, two.salary_min, two.description, two.tags) == ("Diver (Remote, EU)", True, None, "Quoted words in Go.", ["remote", "go"])
    assert all(got[k] is None for k in ("not hiring", "no role", "empty", "null", "late role"))
    assert got["bare paragraphs"].role == "Role Remote Text" and got["bare paragraphs"].location is None
    assert got["marker line"].employment_type == "full-time" and got["marker line"].description == "Remote | Full-time"  # such a line is no meta line
    assert got["url"].links == ["https://x.example/a"] and got["url"].description == "see https://x.example/a now"


BASE, API = "https://api.example/item", "https://api.example/search"


@pytest.fixture(scope="module")
def answers():
    when = 1772323200
    docs = {
        f"{API}": {"hits": [{"objectID": "10", "title": "Ask: Who is hiring? (March)", "created_at_i": when}, {"objectID": "5", "title": "Show: a thing"}, {"objectID": "11", "title": "Who wants to be hired?", "created_at_i": when}, {"objectID": "12", "title": "Who is hiring? (Feb)"}]},
        f"{BASE}/10.json": {"id": 10, "time": when, "kids": [100, 101, 102, 103]},
        f"{BASE}/100.json": {"id": 100, "parent_id": 10, "text": ONE, "kids": [110]},
        f"{BASE}/101.json": {"id": 101, "parent_id": 10, "text": TWO},
        f"{BASE}/102.json": {"id": 102, "deleted": True, "text": ONE},
        f"{BASE}/110.json": {"id": 110, "parent_id": 100, "text": "<p>Reply Co | Clerk</p>"},
    }
    return [(u, json.dumps(d)) for u, d in docs.items()] + [(f"{BASE}/103.json", "[1, 2]")]


def adapter(**kw):
    return adapters.get_adapter("threads", search_api=API, item_base=BASE, web="https://web.example/item?id={id}", name="board", **kw)


def fetch(spark, answers):
    known = spark.createDataFrame(answers, "url string, text string")
    return lambda follows: recorded.answer(follows, known, ignore_query=True)


def test_crawl_of_threads(spark, answers, tmp_path):
    store, a = Store(spark, str(tmp_path)), adapter(threads=1)
    r = crawl(store, a, fetch(spark, answers), datetime(2026, 3, 5))
    assert (r.pages_fetched, r.items_seen, r.items_new, r.failures) == (6, 2, 2, 0)
    rows = {x.external_id: x for x in store.read("job_items").collect()}
    assert rows["100"].url == "https://north.example/apply" and rows["100"].posted_at == datetime(2026, 3, 1) and rows["101"].url == "https://web.example/item?id=101"
    assert "Links: https://north.example/more" in rows["100"].description and json.loads(rows["100"].raw)["thread_id"] == 10
    again = reparse(store, a, datetime(2026, 3, 6))
    assert (again.items_seen, again.items_unchanged, again.detail["marked_inactive"]) == (2, 2, 0)


def test_threads_seekers_and_replies(spark, answers, tmp_path):
    r = crawl(Store(spark, str(tmp_path / "a")), adapter(threads=2), fetch(spark, answers), datetime(2026, 3, 5))
    assert r.failures == 1 and r.items_seen == 2  # the seekers' thread is followed, and not recorded
    pages = spark.createDataFrame([(API, answers[0][1])], "url string, text string")
    assert [x.thread_id for x in thread.search_stage(pages, BASE, 2, include_seekers=False).orderBy("pos").collect()] == [10, 12]
    r = crawl(Store(spark, str(tmp_path / "b")), adapter(threads=1, descend_replies=True), fetch(spark, answers), datetime(2026, 3, 5), adapters_settings(3))
    assert r.items_seen == 3
    comment = spark.createDataFrame([(answers[2][1], 10, 2)], "text string, thread_id long, depth int")
    assert thread.reply_stage(comment, BASE).count() == 0 and thread.thread_stage(spark.createDataFrame([(answers[1][1], None, None)], "text string, thread_id long, posted_at timestamp"), BASE, 2).count() == 2


def adapters_settings(depth):
    from lodestack.config import Settings

    return Settings(max_depth=depth)


def test_bad_documents_give_nothing(spark):
    bad = spark.createDataFrame([("u", t, None, None, 1) for t in ("[]", "nope", "", None, "{}")], "url string, text string, thread_id long, posted_at timestamp, depth int")
    assert thread.search_stage(bad, BASE).count() == 0 and thread.thread_stage(bad, BASE).count() == 0 and thread.comment_stage(bad, "s", "w{id}").count() == 0 and thread.reply_stage(bad, BASE).count() == 0
    assert bad.select(F.count("*")).first()[0] == 5
