import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestack.llm import sharding as S


def check(rows, shards=16):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return sizes


def test_sizes_slots_and_columns(spark):
    rows = [(i if i % 50 else None, f"t{i % 7}", None) for i in range(1003)] + [(5, "same", None)] * 40
    df = spark.createDataFrame([(*r, "own", "x", "y") for r in rows], "doc_id long, text string, n string, _rank string, slot string, _all string")
    got = S.shuffle_into_shards(df).collect()
    check(got)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((a, b) for a, b, _ in rows) and {(r._rank, r._all) for r in got} == {("own", "y")}


def test_same_result_for_another_layout(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    a = {(r.doc_id, r.shard, r.slot) for r in S.shuffle_into_shards(df.repartition(7)).collect()}
    assert a == {(r.doc_id, r.shard, r.slot) for r in S.shuffle_into_shards(df.repartition(2)).collect()}


def test_neighbours_spread(spark):
    got = S.shuffle_into_shards(spark.range(8000).withColumnRenamed("id", "doc_id"), 16).collect()
    first = Counter(r.shard for r in got if r.doc_id < 1600)
    assert all(60 < first[s] < 145 for s in range(16))
    assert abs(np.corrcoef([r.doc_id for r in got], [r.slot for r in got])[0, 1]) < 0.05


def test_equal_rows_spread(spark):
    df = spark.range(8000).selectExpr("if(id < 1600, null, id) doc_id", "if(id < 1600, 'same', cast(id as string)) text")
    got = S.shuffle_into_shards(df).collect()
    check(got)
    first = Counter(r.shard for r in got if r.doc_id is None)
    assert all(60 < first[s] < 145 for s in range(16))
    slots = np.array([r.slot for r in got if r.doc_id is None])
    assert abs(slots.mean() - 250) < 15 and abs(slots.std() - 500 / math.sqrt(12)) < 10


def test_placement_recomputed(spark):
    """Every place again from the hashes alone: ranks, matrix, sub-shards, slots."""
    df = spark.range(700).selectExpr("if(id % 9 = 0, null, id) doc_id", "if(id % 3 = 0, 'x', cast(id as string)) text")
    shards, seed, buckets, subs = 5, 20240501, 16, 7
    rows = [r.asDict() for r in S.keys_of(S.numbered(df), buckets, subs, seed).withColumn("o3", S._hash(seed, 3)).collect()]
    by = defaultdict(list)
    for r in rows:
        by[r["_bucket"]].append(r)
    matrix = S.communication_matrix([len(by[b]) for b in range(buckets)], shards, seed)
    for b, own in by.items():
        own.sort(key=lambda r: (r["_o"], r["_h"], r["_n"]))
        for r, s in zip(own, [s for s in range(shards) for _ in range(matrix[b, s])], strict=True):
            r["shard"] = s
    want = []
    for s in range(shards):
        own = sorted((r for r in rows if r["shard"] == s), key=lambda r: (r["_sub"], r["o3"], r["_h"], r["_n"]))
        want += [(r["_all"]["doc_id"], r["_all"]["text"], s, k) for k, r in enumerate(own)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in S.shuffle_into_shards(df, shards).collect())


def test_rows_move_once(spark, sf):
    df = S.shuffle_into_shards(spark.read.parquet(f"{sf}/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_few_rows_and_none(spark):
    df = spark.range(3).withColumnRenamed("id", "doc_id")
    assert sorted(check(S.shuffle_into_shards(df).collect())) == [0] * 13 + [1] * 3
    assert S.shuffle_into_shards(df.limit(0)).collect() == []


def test_matrix_has_its_margins():
    rows = [0, 5, 1000, 3, 77]
    m = S.communication_matrix(rows, 16, 1)
    assert m.sum(axis=1).tolist() == rows and set(m.sum(axis=0).tolist()) <= {1085 // 16, 1085 // 16 + 1}


@pytest.mark.parametrize("good,bad,n", [(40, 60, 30), (3000, 1000, 800)])
def test_large_urn_law(good, bad, n):
    rng = np.random.default_rng(7)
    own = np.array([S._ratio_of_uniforms(rng, good, bad, n) for _ in range(20000)])
    ref = np.random.default_rng(8).hypergeometric(good, bad, n, 20000)
    assert abs(own.mean() - ref.mean()) < 0.05 * ref.std() and abs(own.std() / ref.std() - 1) < 0.03
    values = np.arange(min(own.min(), ref.min()), max(own.max(), ref.max()) + 1)
    assert max(abs((own <= v).mean() - (ref <= v).mean()) for v in values) < 0.02


def test_map_columns_travel_along(spark):
    df = spark.range(50).selectExpr("id doc_id", "map('k', id) m")
    assert all(r.m == {"k": r.doc_id} for r in S.shuffle_into_shards(df).collect())
