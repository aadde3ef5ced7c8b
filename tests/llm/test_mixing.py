import math
from collections import Counter

import pytest

from lodestack.llm import catalog, shared
from lodestack.llm import mixing as M


def test_copies_follow_the_poisson_law(spark):
    df = spark.range(40000).selectExpr("id doc_id", "case when id % 10 = 0 then 'small' when id % 10 < 9 then 'big' end source", "'x' as rate")
    rows = M.replicate(df, {"small": 0.5, "big": 0.5}).collect()
    n = Counter(r.source for r in rows)
    assert None not in n and all(abs(n[s] - 20000) < 700 for s in ("small", "big"))
    per = Counter(r.doc_id for r in rows if r.source == "small")
    assert abs(sum(v == 5 for v in per.values()) / 4000 - math.exp(-5) * 5**5 / 120) < 0.03
    assert all(sorted(r.copy for r in rows if r.doc_id == d) == list(range(1, per[d] + 1)) for d in (0, 10, 20))


def test_defaults_keep_null_sources_and_ids(spark):
    df = spark.createDataFrame([(i, None) for i in range(200)] + [(None, "a")] * 50 + [(1000 + i, "b") for i in range(400)], "doc_id long, source string")
    rates = {r.source: r.rate for r in M.rates(df).collect()}
    shares = {None: math.sqrt(200), "a": math.sqrt(50), "b": 20.0}
    assert all(abs(rates[s] - 650 * w / sum(shares.values()) / {None: 200, "a": 50, "b": 400}[s]) < 1e-9 for s, w in shares.items())
    seen = Counter(r.source for r in M.replicate(df).collect())
    assert seen[None] and seen["a"]


@pytest.mark.parametrize("most", [0, 200_000])
def test_rows_without_an_id_and_equal_rows_draw_on_their_own(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "BROADCAST_REPEATS", most)
    monkeypatch.setattr(shared, "CHUNK", 100)
    texts = [None] * 600 + [f"t{k}" for k in range(1000)] + ["one"] + ["two"] * 2
    df = spark.createDataFrame([(None, "a", t) for t in texts], "doc_id long, source string, text string")
    rows = M.replicate(df).collect()
    n = Counter(r.text is None for r in rows)
    assert 480 < n[True] < 720 and 850 < n[False] < 1160
    assert Counter(r.shuffle_key for r in rows).most_common(1)[0][1] == 1
    assert abs(sum(r.copies == 1 for r in rows if r.text is None) / 600 - math.exp(-1)) < 0.08
    assert sorted(map(str, rows)) == sorted(map(str, M.replicate(df.repartition(7)).collect()))
    parts = Counter(r.p for r in M.replicate(df).selectExpr("spark_partition_id() p").collect())
    assert len(parts) == 4 and max(parts.values()) < 2 * min(parts.values())


def test_equal_moments_are_told_apart(spark):
    df = spark.sql("select timestamp_micros(1 + id) t, array(timestamp_micros(id)) a, map('k', id) m, cast(null as string) source, 1 doc_id from range(40)")
    assert {r.t for r in M.replicate(df, size=400).select("t").collect()} == {r.t for r in df.collect()}


def test_shuffled_and_repeatable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    a, b = (sorted(tuple(r) for r in M.replicate(d).collect()) for d in (docs, docs.repartition(5)))
    assert a == b
    order = [r.doc_id for r in M.replicate(docs).collect()]
    assert order != sorted(order)


def test_join_without_broadcast(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    want = sorted(tuple(r) for r in M.replicate(docs).collect())
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    assert sorted(tuple(r) for r in M.replicate(docs).collect()) == want


def test_clashing_columns_travel_along(spark):
    df = spark.createDataFrame([(k, "a", "u", "v") for k in range(60)], "doc_id long, source string, _all string, _id string")
    rows = M.replicate(df).collect()
    assert {(r._all, r._id) for r in rows} == {("u", "v")} and len(rows) > 30


def test_large_rates_and_empty(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    n = M.replicate(df, size=2000).count()
    assert abs(n - 2000) < 250
    assert M.replicate(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        M.replicate(df, {"b": 1.0})


def test_no_python_in_the_plan(spark, sf):
    plan = M.replicate(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_mixes_whole_documents(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(catalog, "materialise", lambda df, label: made.append(shared.materialise(df, label)) or made[-1], raising=False)
    listed = catalog.QUERIES["op9_mixing"](spark, sf)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    (mix,) = made
    rows = mix.collect()
    assert rows and all(all(r[c] == docs[r.doc_id][c] for c in ("text", "lang", "source", "n_chars")) for r in rows)
    assert sorted((r.doc_id, r.copy, r.shuffle_key) for r in rows) == sorted((r.doc_id, r.copy, r.shuffle_key) for r in listed.collect())
