"""Python's memory in the parsers: rows leave in small parts, and few workers stand behind a task."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.functions import arrow, text
from lodestack.operators import board, thread
from lodestack.plans.catalog import QUERIES


@pytest.mark.parametrize(
    ("of", "kind", "columns"),
    [
        (thread._parts, thread._ARROW, (pa.array(["<p>Firm | Role</p><p>" + "word " * 800 + "</p>"] * 5000), pa.array([" Firm | Role\n " + "word " * 800 + "\n"] * 5000))),
        (lambda m: board.parse_page("detail", m, None, CONFIG), board._RESULT, (pa.array(["<h1>T</h1><article>" + "word " * 800 + "</article>"] * 5000),)),
    ],
)
def test_parts_are_small_whatever_the_batch(of, kind, columns):
    tracemalloc.start()
    rows = most = 0
    for part in arrow._parts(of, kind, columns):
        rows, most = rows + len(part), max(most, part.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 5000 and most < 4 << 20 and peak < 16 << 20  # the batch has 20 MB and more


class _Spec:
    fields, multi_fields, tag_separators, remove = {"title": "h1::text", "description": "article::html"}, ["tags"], [], None


class CONFIG:
    detail = _Spec


def test_two_workers_parse_comments(spark, sf):
    """One for the text and the fold, one for entities; the readable text had a third."""
    plan = QUERIES["thread_parse"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_rows_nulls_and_empty_tables(spark):
    double = arrow.row_by_row(lambda a, b: None if a is None else f"{a}{b}", "string", pa.string())
    large = arrow.row_by_row(lambda a: {"n": None if a is None else a * 2, "w": ["x"] * (a or 0)}, "struct<n:bigint,w:array<string>>", pa.struct([("n", pa.int64()), ("w", pa.list_(pa.string()))]), large=True)
    df = spark.range(3000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("a"))
    got = df.select("a", double("a", F.lit("!")).alias("d"), large("a").alias("l")).collect()
    assert all((r.d, r.l.n, len(r.l.w)) == ((None, None, 0) if r.a is None else (f"{r.a}!", 2 * r.a, r.a)) for r in got) and len(got) == 3000
    none = df.where("a < 0")
    assert none.select(double("a", F.lit("!")), large("a")).count() == 0 and none.select(double("a", F.lit("!")), large("a")).collect() == []
    assert [r[0] for r in spark.createDataFrame([("&lt;&amp",), (None,), ("a",)], "t string").select(text.unescape(F.col("t"))).collect()] == ["<&", None, "a"]
