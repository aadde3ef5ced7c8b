from datetime import datetime

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import display, hashing, text, urls


def run(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.select("k", fn(F.col("v")).alias("o")).orderBy("k").select("o").collect()]


@pytest.mark.parametrize(
    "fn,pairs",
    [
        (text.normalise_text, [(None, ""), ("  a \n b\x1c ", "a b"), ("<script>x</script>Tom &amp; J&eacute;r&#244;me&nbsp;!", "Tom & Jérôme !"), ("<style>a</style>", "")]),
        (text.html_to_text, [(None, ""), ("<p>One</p><p>Two<br>Three</p>", "One\nTwo\nThree"), ("a &amp;lt;b&amp;gt; c", "a <b> c"), ("x<p>y", "x y"), ("<li>a</li>\n\n<li> </li>b", "a\nb")]),
        (lambda c: text.truncate(c, 5), [("abcdefghij", "abcd…"), ("abcde", "abcde"), ("abc   zzz", "abc…")]),
        (text.parse_money, [("$34,500", 34500.0), ("34k", 34000.0), ("2.5M", 2500000.0), ("61 300", 61300.0), ("61\u00a0300", 61300.0), ("", None), ("no digits here", None)]),
        (text.detect_currency, [("100 eur", "EUR"), ("£5", "GBP"), ("5 € or $", "USD"), ("USD120k", None), (None, None)]),
        (text.looks_remote, [("Sailor, remote (Baltic)", True), ("Fully remote", True), ("Turku, Finland", False), ("Hybrid", False), (None, False)]),
        (text.detect_employment_type, [("A full-time cook", "full-time"), ("Contract diver", "contract"), ("Freelance pilot", "contract"), ("Winter internship", "internship"), ("co-op", "internship"), ("other", None), (None, None)]),
        (text.tech_tags, [("Golang at Google, JavaScript", ["go", "golang", "java", "javascript"]), (None, [])]),
        (text.split_tags, [("a, b|c;d · e,,", ["a", "b", "c", "d", "e"]), ("R&D, x", ["R&D", "x"]), (None, [])]),
        (text.scrub_pii, [("mail jo.x+y@site.example now", "mail [redacted] now"), ("call +1 (555) 123-4567", "call [redacted]"), ("on 2026-02-11 pay €85,000", "on 2026-02-11 pay €85,000"), ("ref 123456789", "ref [redacted]"), ("see https://careers.test/jobs/1?ref=hn now", "see https://careers.test/jobs/1 now"), ("a\nb", "a b")]),
        (text.is_hiring_thread, [("Ask: Who is hiring? (May)", True), ("Who wants to be hired?", True), ("Show", False), (None, False)]),
        (text.is_posting, [("We're not hiring", False), ("position closed", False), ("Hiring", True)]),
    ],
)
def test_functions(spark, fn, pairs):
    assert run(spark, fn, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_salaries(spark):
    pairs = [
        ("$37k - $41k USD", (37000, 41000, "USD")), ("€31,250 – €47,900", (31250, 47900, "EUR")), ("£28,640", (28640, 28640, "GBP")), ("17-23 EUR per hour", (17, 23, "EUR")),
        ("By agreement", (None, None, None)), ("$93k - $71k", (71000, 93000, "USD")), ("a 401k plan and $88k base", (88000, 401000, "USD")), ("3% equity, $64k", (3, 64000, "USD")),
        ("62.000 €", (62, 62, "EUR")), ("USD77k", (None, None, None)), ("5 years", (None, None, None)), ("salary 53900", (53900, 53900, None)), (None, (None, None, None)),
    ]
    assert [tuple(r) for r in run(spark, text.parse_salary, [a for a, _ in pairs])] == [b for _, b in pairs]


def test_dates(spark):
    day = datetime(2026, 2, 11)
    pairs = [
        ("2026-02-11", day), ("Feb 11, 2026", day), ("posted 11th February 2026", day), ("02/11/2026", day), ("11/02/2026", datetime(2026, 11, 2)), ("25/12/2026", datetime(2026, 12, 25)), ("2026-13-45", None),
        ("2026-02-11 09:30", day), ("2026-02-11T09:30", datetime(2026, 2, 11, 9, 30)), ("2026-02-11T09:30:00Z", datetime(2026, 2, 11, 9, 30)), ("2026-02-11T09:30:00+02:00", datetime(2026, 2, 11, 7, 30)),
        ("13/13/2026", None), ("yesterday", None), ("", None), (None, None),
    ]
    assert run(spark, text.parse_date, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_retry_after(spark):
    now = F.lit(datetime(2026, 1, 1))
    values = ["5", "-3", "1.5", "Thu, 01 Jan 2026 00:00:30 GMT", "Wed, 31 Dec 2025 23:00:00 GMT", "soon", None]
    assert run(spark, lambda c: text.retry_after_seconds(c, now), values) == [5.0, 0.0, 1.5, 30.0, 0.0, None, None]


def test_urls(spark):
    pairs = [
        (urls.canonical_url, [("HTTPS://Quay.TEST/berths?z=9&k=4#deck", "https://quay.test/berths?k=4&z=9"), (" http://x/A?#f ", "http://x/A"), ("http://x/?&&b", "http://x/?b")]),
        (urls.host_of, [("http://quay.test:8091/x", "quay.test:8091"), ("https://Q.test:443/", "q.test"), ("http://q.test:80", "q.test"), ("Mailto", "mailto"), ("http://u:p@h.com/", "h.com")]),
        (urls.robots_url, [("https://a.b:1/x?y#z", "https://a.b:1/robots.txt")]),
        (urls.redact_credentials, [("mysql://me:secret@quay/boats", "mysql://***@quay/boats"), ("file:///boats", "file:///boats")]),
        (urls.strip_query, [("http://a/b?c?d", "http://a/b")]),
    ]
    for fn, cases in pairs:
        assert run(spark, fn, [a for a, _ in cases]) == [b for _, b in cases]
    sites = [("http://quay.test/a", "http://quay.test", True), ("http://www.quay.test", "http://quay.test", True), ("http://a.quay.test", "http://quay.test", True), ("http://quay.test", "http://other.test", False), ("", "http://x", False), ("http://xquay.test", "http://quay.test", False)]
    df = spark.createDataFrame(sites, "a string, b string, want boolean")
    assert df.where(urls.same_site(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    base = "https://quay.test/berths"
    assert [urls.join_url(base, h) for h in ("/ships/7", "ships/7", "#deck", "javascript:go()", "mailto:y", "", None, "ftp://y")] == ["https://quay.test/ships/7"] * 2 + [None] * 6
    assert urls.with_query_param("http://q/s?deck=1&y=", "deck", 5) == "http://q/s?deck=5&y="


def test_hashes(spark):
    ids = {"1001": "18c4e60b47c696ce9227d29a", "1005": "e11205546c35044eca5c926c"}
    assert run(spark, hashing.url_id, [f"https://demo-board.example/jobs/{k}" for k in ids]) == [*ids.values()]
    row = ("Backend Engineer", "Acme", "Berlin", False, None, 100000.0, 100000.0, "EUR", "Work on things.", ["Python"])
    kinds = "title string, company string, location string, remote boolean, employment_type string, salary_min double, salary_max double, salary_currency string, description string, tags array<string>"
    df = spark.createDataFrame([row, (*row[:9], ["b", "a"]), (*row[:9], ["a", "b"]), (*row[:4], "", *row[5:])], kinds)
    compat = [r[0] for r in df.select(hashing.content_hash_compat(F.struct(*hashing.CONTENT))).collect()]
    assert compat[0] == "1faf9aa2d8e4553512b3064cfe84aeab5ef34145bad342b99c9876465f11dd4e" and compat[1] == compat[2]
    own = [r[0] for r in df.select(hashing.content_hash()).collect()]
    assert own[1] == own[2] and len(set(own)) == 3
    assert df.select(hashing.search_text(*[F.col(c) for c in ("title", "company", "location", "employment_type", "tags", "description")])).first()[0] == "Backend Engineer Acme Berlin Python Work on things."


def test_display(spark):
    df = spark.createDataFrame([(85000.0, 105000.0, "EUR"), (50.0, 50.0, None), (None, 1234.0, "USD"), (None, None, "USD")], "a double, b double, c string")
    assert [r[0] for r in df.select(display.salary_display(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["EUR 85k – 105k", "50", "USD 1,234", "—"]
    assert run(spark, lambda c: display.share_display(c, F.lit(8)), [1, 4], "int") == ["12%", "50%"]


def test_heuristics_that_are_the_definition(spark):
    assert run(spark, text.looks_remote, ["distributed systems"]) == [True]
    assert run(spark, text.detect_employment_type, ["internal tools"]) == ["internship"]
    assert run(spark, text.is_posting, ["We closed our round, hiring"]) == [False]


@settings(max_examples=12, deadline=None, phases=[Phase.generate], derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["http", "HTTPS"]), st.sampled_from(["A.test", "b.Test:81"]), st.text("ab/%.", max_size=6), st.lists(st.text("xy=1", max_size=4), max_size=4), st.sampled_from(["", "#", "#f?x"])), min_size=1, max_size=20))
def test_canonical_urls_are_stable(spark, parts):
    made = [f"{s}://{h}/{p}" + ("?" + "&".join(q) if q else "") + f for s, h, p, q, f in parts]
    once = run(spark, urls.canonical_url, made)
    assert run(spark, urls.canonical_url, once) == once
    shuffled = [f"{s}://{h}/{p}" + ("?" + "&".join(reversed(q)) if q else "") + f for s, h, p, q, f in parts]
    assert run(spark, urls.canonical_url, shuffled) == once


@settings(max_examples=12, deadline=None, phases=[Phase.generate], derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from(list("ab \n\t\x1c\u00a0<p>/br&;lt123-+()@.é…")), max_size=40), min_size=1, max_size=20))
def test_text_functions_as_python_would(spark, values):
    import html
    import re

    def plain(t):
        t = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", t)
        return re.sub(r"\s+", " ", html.unescape(t)).strip()

    assert run(spark, text.normalise_text, values) == [plain(v) for v in values]
    assert run(spark, text.normalise_ws, values) == [re.sub(r"\s+", " ", v).strip() for v in values]
    assert run(spark, lambda c: text.truncate(c, 9), values) == [v if len(v) <= 9 else v[:8].rstrip() + "…" for v in values]
