import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestack.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "Hello  World\n", "a", "it's <|endoftext|> <|ENDOFTEXT|>x", "ΣΑΣ İstanbul é", "Ärger öffnen 12 345", "word " * 9000, "a", "a"]


def check(rows, docs, capacity=4096):
    """Every id of every document in one piece, pieces gapless in their sequences."""
    tok = Tokenizer.from_file(PATH)
    ids = [(d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for d, t in docs]
    want = sorted((d, 4 * 0 + s, min(capacity, len(raw) // 4 - s), zlib.crc32(raw[4 * s : 4 * (s + capacity)]), len(raw) // 4) for d, raw in ids for s in range(0, len(raw) // 4, capacity))
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_odd_documents(spark):
    docs = list(enumerate(ODD)) + [(4, ODD[4])]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, offset int")
    check(P.pack_documents(df, PATH).collect(), docs)


def test_null_id_and_empty_table(spark):
    assert len(P.pack_documents(spark.createDataFrame([(None, "x")], "doc_id long, text string"), PATH).collect()) == 1
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_whole_table_has_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = P.pack_documents(docs, PATH).collect()
    n = check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sum(r.length for r in rows) > 0.97 * 4096 * (n - 1)


def test_sequences_carry_the_ids(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "a b " * 40)], "doc_id long, text string")
    packed = P.pack_documents(df, PATH, capacity=64, keep_ids=True)
    rows = {r.sequence_id: r for r in P.sequences(packed, 9, 64).collect()}
    for p in packed.collect():
        ids = np.frombuffer(rows[p.sequence_id].ids, "<u4")
        assert len(ids) == (64 if rows[p.sequence_id].n_tokens.bit_count() != 1 else rows[p.sequence_id].n_tokens) and zlib.crc32(ids[p.offset : p.offset + p.length].tobytes()) == p.ids_crc32
    assert all(set(np.frombuffer(r.ids, "<u4")[r.n_tokens :].tolist()) <= {9} for r in rows.values())


def test_place_uses_every_piece_once():
    rng = random.Random(3)
    histogram = [(n, rng.randint(1, 50)) for n in range(1, 200)] + [(4096, 7), (3000, 5)]
    load, seen = defaultdict(int), defaultdict(int)
    for length, rank, count, first, offset in P.place(histogram):
        assert rank == seen[length]
        seen[length] += count
        for k in range(count):
            assert load[first + k] == offset
            load[first + k] += length
    assert seen == dict(histogram) and max(load.values()) <= 4096
    assert sorted(load) == list(range(len(load)))
    assert sum(load.values()) > 0.95 * 4096 * len(load)


def test_long_texts_in_windows(monkeypatch):
    monkeypatch.setattr(P, "WINDOW", 15)
    text = "It's  a b\n c é <|endoftext|> d\u3000e 12 !? ΣΑΣ x " * 30
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert P.WordEncoder(PATH).encode(text) == np.array(ids, "<u4").tobytes()


def test_no_padding_at_a_power_of_two(spark):
    df = spark.createDataFrame([(k, "a " * 31) for k in range(3)] + [(9, "b " * 40)], "doc_id long, text string")
    packed = P.pack_documents(df, PATH, capacity=63, keep_ids=True).cache()
    sizes = sorted((r.n_tokens, len(r.ids) // 4) for r in P.sequences(packed, 9, 63).collect())
    assert (32, 32) in sizes and (41, 63) in sizes
    assert {n for _, n in [(r.n_tokens, len(r.ids) // 4) for r in P.sequences(packed, 9, 63, powers=False).collect()]} == {63}


def test_other_tokenizers_go_through_the_library():
    other = public_tokenizers.path("byte_bpe_50k.json")
    text = "It's  a b\n c é <|endoftext|> d\u3000e 12 !? ΣΑΣ x "
    assert P.WordEncoder(PATH).plain and not P.WordEncoder(other).plain
    assert P.WordEncoder(other).encode(text) == np.array(Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("crowd", [100, 10**6])
def test_repeated_rows_and_clashing_columns(spark, monkeypatch, crowd):
    monkeypatch.setattr(P, "CROWD", crowd)
    df = spark.createDataFrame([(1, "one two", 5, "s", "x")] * 700 + [(2, "three", 1, "t", "y")], "doc_id long, text string, length int, _sub string, sequence_id string")
    rows = P.pack_documents(df, PATH).collect()
    check(rows, [(1, "one two")] * 700 + [(2, "three")])


def test_many_texts_at_once_as_by_the_library(monkeypatch):
    monkeypatch.setattr(P, "GROUP", 300)
    monkeypatch.setattr(P, "WINDOW", 90)
    rng = random.Random(5)
    runs = ["It's", "IT'S,", "x's.", "dogs'", "''s", "a»,", "«é»", "1½,", "ab12,.", "İ", "İ,", "i\u02c6", "Ⱥb!", "...", "_a_", "a\x07,", "a\x00", "\x85b,", "c\xa0d,\xa0", "e,\xa0", "<|endoftext|>", "x<|ENDOFTEXT|>,", "F <| g", "日本", "…", "don't!!", "'llama", "Straße", "ǅ-", "€5", "ª²"]
    texts = ["", " ", "\n\n"] + ["".join(rng.choice(runs) + rng.choice([" ", "\n", "  ", "\t", ""]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    tok = Tokenizer.from_file(PATH)
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert P.WordEncoder(PATH).encode_all(texts) == want


def test_every_usual_character_as_by_the_library():
    tok, encoder = Tokenizer.from_file(PATH), P.WordEncoder(PATH)
    usual = [c for c in map(chr, range(0x2100)) if not P.UNUSUAL.match(c)]
    texts = [form.replace("@", c) for c in usual for form in ("@", "a@", "A@b", "a@,", "a,@", "1@'s", "é@!x", "@@ @")]
    got = encoder.encode_all(texts)
    assert [t for t, raw in zip(texts, got, strict=True) if raw != np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()] == []


def test_common_words_outlive_the_rare_ones(monkeypatch):
    """What takes the time is merging: a word that every text holds is merged once, however many rare ones pass by."""
    monkeypatch.setattr(P, "CACHE_WORDS", 50)
    encoder, seen = P.WordEncoder(PATH), []
    merge = encoder.merge
    encoder.merge = lambda part: seen.append(part) or merge(part)
    for k in range(40):
        encoder.encode(" ".join(["Everyday", "everyday,", *("rare" + "".join(chr(97 + int(d)) for d in f"{20 * k + i:04}") for i in range(20))]))
    assert seen.count("everyday") == 1 and len(seen) == 40 * 20 + 2
