import random

import pytest

from lodestack.llm import shared, simhash
from lodestack.llm import similar_texts as S

SCHEMA = "doc_id long, text string"


def word_shingles(text, k=5):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_keep(items, least=0.8):
    """Smallest id of each component of (doc_id, text) by comparing all pairs."""
    sets = [word_shingles(t) for _, t in items]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both / len(sets[a] | sets[b]) >= least:
                root[find(a)] = find(b)
    low = {}
    for k, (d, _) in enumerate(items):
        low[find(k)] = min(d, low.get(find(k), d))
    return sorted(low.values())


def kept(spark, items, **more):
    return sorted(r.doc_id for r in S.survivors(spark.createDataFrame(items, SCHEMA), **more).collect())


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_edited_copies_and_unlike_texts(spark):
    rng, items = random.Random(3), []
    for k in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(40, 400))]
        items.append((10 * k, " ".join(words)))
        items += [(10 * k + j, edited(rng, words, max(1, len(words) * j // 90))) for j in (1, 2, 4)]
    items += [(9000, ""), (9001, None), (9002, " \n"), (9003, "Solo"), (9004, "solo"), (9005, "solo two")]
    want = brute_keep(items)
    assert 50 < len(want) < 110 and kept(spark, items) == want


def test_a_chain_whose_ends_are_unlike(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)
    words = [f"w{k}" for k in range(700)]
    items = [(k, " ".join(words[8 * k : 8 * k + 200])) for k in range(60)]
    random.Random(1).shuffle(items)
    assert brute_keep(items) == [0] and kept(spark, items) == [0]


def test_documents_against_brute_force(spark, sf):
    items = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert kept(spark, items) == brute_keep(items)


def test_null_ids_repeated_rows_and_extra_columns(spark):
    rows = [(3, "a b c d e", 1), (3, "a b c d e", 1), (None, "x y z", 2), (None, "x y z", 2), (4, "A B  c d e", 3), (3, "other words here", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long").selectExpr("*", "'u' as _row", "'b' as bands", "1 as label")
    out = S.survivors(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text, r.node, r._row, r.bands, r.label) for r in out.collect()) == [(0, "x y z", 2, "u", "b", 1), (3, "a b c d e", 1, "u", "b", 1), (3, "other words here", 4, "u", "b", 1)]


def test_empty(spark):
    assert kept(spark, []) == []


@pytest.mark.parametrize("n", [1, 7, 500])
def test_long_texts_in_chunks(monkeypatch, n):
    text = " ".join(str(i % 97) for i in range(n)).encode()
    whole = S.shingle_set(text)
    keys = S.bands(whole).tolist()
    monkeypatch.setattr(simhash, "CHUNK", 11)
    monkeypatch.setattr(S, "STEP", 3)
    assert S.shingle_set(text).tolist() == whole.tolist() and S.bands(whole).tolist() == keys
    assert len(whole) == len(word_shingles(text.decode()))


@pytest.mark.parametrize("own,inside", [(None, "1000"), ("10000", "1000"), ("500", "500"), ("0", "1000")])
def test_arrow_batches_are_small_only_while_written(spark, own, inside):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(name)
    if own:
        spark.conf.set(name, own)
    try:
        with shared._small_batches(spark), shared._small_batches(spark):
            assert spark.conf.get(name) == inside
        assert spark.conf.get(name, None) == own
    finally:
        spark.conf.unset(name)
