import public_tokenizers
from tokenizers import Tokenizer

from lodestack.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "  two  spaces \n\n\tx", "it's we'll they'd 'x", "<|endoftext|> in <|endoftext|>text", "日本語 テキスト é́ \x1c\x1d ok", "Ωmega ½ ² 12345 ǅ", "x" * 30000, "a b " * 3000, "a", "a"]


def brute(texts):
    tok = Tokenizer.from_file(PATH)
    return [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_odd_texts_and_repeats(spark):
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(ODD)]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in T.token_counts(df, PATH).collect())
    want = sorted((i if i is not None else -1, len((t or "").encode()), n, n > 1024) for (i, t, _), n in zip([*rows, rows[5]], brute([r[1] for r in [*rows, rows[5]]]), strict=True))
    assert got == want


def test_empty_table(spark):
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows]), strict=True))
    assert {r.doc_id: r.n_tokens for r in T.token_counts(docs, PATH).collect()} == want


def test_long_texts_in_windows():
    text = "it's  a b\n c é <|endoftext|> d\u3000e 12 !? x " * 50
    counter = T.PieceCounter.of(PATH)
    parts = list(T.windows(text, 20))
    assert "".join(parts) == text and len(parts) > 20
    assert sum(counter.pieces([w for p in parts for some in counter.split(p) for w in some])) + counter.specials_in(text) == brute([text])[0]


def test_rows_behind_a_shuffle_are_written_first(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = dict(zip([r.doc_id for r in docs.collect()], brute([r.text for r in docs.collect()]), strict=True))
    found = T.count_tokens(docs.repartition(3), PATH)
    assert "RoundRobin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.n_tokens for r in found.collect()} == want


def test_other_tokenizers_are_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        T.count_tokens(spark.createDataFrame([(1, "x")], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"))
