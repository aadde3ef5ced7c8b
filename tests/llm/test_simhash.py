import random

import numpy as np
import pytest
import xxhash

from lodestack.llm import simhash as S
from lodestack.llm.components import connected_components


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    """items: (doc_id, fp); component of each fp by pairwise comparison."""
    fps = sorted({f for _, f in items})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(fps[a])] = find(fps[b])
    low = {}
    for d, f in items:
        if d is not None:
            low[find(f)] = min(d, low.get(find(f), d))
    return {f: low.get(find(f)) for f in fps}


def unsigned(x):
    return x & (1 << 64) - 1


def test_fingerprint_against_definition():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "one", "One two", "a b c", "É é A b", "x" * 5000] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    for t in texts:
        assert S.fingerprint(t.encode() if t is not None else None) == brute_fingerprint(t)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(500))
    monkeypatch.setattr(S, "CHUNK", 7)
    assert S.fingerprint(text.encode()) == brute_fingerprint(text)


def test_gray_rank_orders_neighbours(spark):
    rows = spark.range(64).select(S.F.col("id"), S.gray_rank(S.F.col("id")).alias("r")).orderBy("r").collect()
    ids = [r.id for r in rows]
    assert all((a ^ b).bit_count() == 1 for a, b in zip(ids, ids[1:]))


@pytest.mark.parametrize("n,leaf", [(300, 32), (60, 8192)])
def test_links_give_brute_force_components(spark, n, leaf):
    rng = random.Random(n)
    fps = {0}
    while len(fps) < n:
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randint(0, 5)):
            fps.add(base ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randint(1, 4))}))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = connected_components(S.links(df, len(fps), 3, leaf)).collect()
    want = brute_components(list(enumerate(fps)))
    groups = {}
    for r in found:
        groups.setdefault(r.label, set()).add(unsigned(r.node))
    wanted = {}
    for f, c in want.items():
        wanted.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in wanted.values() if len(g) > 1)


def test_dense_group_reports_a_forest():
    base = 0b1011 << 40
    near = np.array(sorted({base ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)}), np.uint64)
    i, j = S.forest(near, None, 3)
    assert len(i) == len(near) - 1 and len(set(j.tolist())) == 1


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (900000, ""), (900001, None), (900002, "solo"), (900002, "solo"), (900003, "other text")], "doc_id long, text string")
    docs = docs.union(extra)
    got = sorted((r.doc_id if r.doc_id is not None else -1, unsigned(r.fp), r.component_id) for r in S.near_duplicates(docs, leaf=64).collect())
    items = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = brute_components(items)
    assert got == sorted((d if d is not None else -1, f, want[f]) for d, f in items)


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7), (None, 3), (5, 6)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(300)}


def test_crowded_range_goes_to_its_last_leaf(spark, monkeypatch):
    monkeypatch.setattr(S, "SEQ_BITS", 2)
    df = spark.range(400).selectExpr("xxhash64(id) fp")
    rows = S.leaves(df, 1, 8).collect()
    assert sorted(r.key for r in rows) == [0, 1, 2, 3] and sum(len(r.fps) for r in rows) == 400 * 8


def test_release_deletes_what_was_written(spark):
    from lodestack.llm import shared

    shared.release(spark)
    df = shared.materialise(spark.range(5), "t")
    assert df.count() == 5 and shared.release(spark) == 1 and shared.release(spark) == 0
