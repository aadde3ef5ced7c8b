import math
import random

import pytest
from pyspark.sql import functions as F

from lodestack.llm import top_k as K


def brute(rows, k=10):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted((i, r) for (i, r) in ok if i % 100 == 0):
        asked.setdefault(i, v)
    out = []
    for q, v in asked.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, x)), i) for i, x in ok if i != q and len(x) == len(v)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_odd_rows_against_brute_force(spark, monkeypatch, block):
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(900)]
    rows += [(1000 + i, [0.5, -0.25, 0.125, 1.0, 2.0]) for i in range(60)]  # ties
    rows += [(2000, None), (2001, []), (2100, [1.0, None, 2.0, 0.0, 0.0]), (2200, [math.nan] * 5), (2300, [math.inf, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 5)]
    rows += [(3000, [1.0, 2.0, 3.0]), (3001, [2.0, 2.0, 2.0]), (5, rows[5][1]), (200, rows[200][1]), (300, [9.0, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    real = K._packed
    monkeypatch.setattr(K, "BLOCK", block)
    got = sorted(tuple(r) for r in K.top_k(df, F.col("vec_id") % 100 == 0, 10).collect())
    assert real is K._packed and got == brute(rows)


def test_groups_of_queries(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(K, "GROUP_BYTES", 800)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in K.top_k(df, F.col("vec_id") % 100 == 0).collect()) == brute(rows)


def test_huge_components_saturate(spark):
    df = spark.createDataFrame([(0, [1e150, 1.0]), (1, [1e150, 2.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in K.top_k(df, F.col("vec_id") % 100 == 0).collect()}
    assert got[1] == K.LONG


def test_blocks_stay_and_share_of_candidates(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) + 30 * (i % 4) for _ in range(3)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    share = []
    for block in (2000, 100):
        monkeypatch.setattr(K, "BLOCK", block)
        found = K.candidates(df, F.col("vec_id") % 100 == 0, n_pivots=8)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        share.append(found.agg(F.sum("evaluated")).first()[0] / (20 * 1999))
    assert all(0 < s < 0.6 for s in share)


def test_pruning_skips_candidates():
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.floor(np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(50, 1, (500, 3))]) * 10)
    q, p = x[700], x[:20]
    seen = []
    real, K._products = K._products, lambda a, b: (seen.append(len(a)), real(a, b))[1]
    try:
        K.search(np.arange(1000), x, K._distances(x, p), 700, q, K._distances(x[700:701], p)[0], None, 10)
    finally:
        K._products = real
    assert sum(seen) < 600


def test_empty(spark):
    assert K.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []
