from collections import Counter

import corpus_pipeline as C
import public_tokenizers
from tokenizers import Tokenizer

from lodestack.llm import mixing, quality_rules
from tests.llm.test_similar_texts import brute_keep


def rows(df):
    return sorted(map(str, df.collect()))


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    found = C.materialise(C.language_id(spark, docs, sf), "t1")
    assert found.columns == columns and {r.doc_id for r in docs.collect()} == {r.doc_id for r in found.collect()}
    ruled = C.materialise(C.quality_rules(spark, found, sf), "t2")

    def passes(text):
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure(text)))
        return not any(eval(rule.replace("AND", "and"), {}, m) for rule in quality_rules.RULES.values())  # noqa: S307

    assert sorted(r.doc_id for r in ruled.collect()) == sorted(r.doc_id for r in found.collect() if passes(r.text))
    single = C.materialise(C.near_dedup(spark, ruled, sf), "t3")
    assert sorted(r.doc_id for r in single.collect()) == brute_keep([(r.doc_id, r.text) for r in ruled.collect()])
    mixed = C.materialise(C.mix_sources(spark, single, sf), "t4")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter(r.doc_id for r in mixing.replicate(single).collect()) and mixed.columns == columns
    packed = C.pack(spark, mixed, sf).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(copies[r.doc_id] * (len(tok.encode(r.text, add_special_tokens=False).ids) + 1) for r in single.collect())
    assert sum(r.length for r in packed) == want
    assert rows(C.run(spark, sf)) == sorted(map(str, packed))


def test_odd_rows_and_extra_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = [(None, None, None, None, None), (-1, "", "en", None, 0), (-2, "123 456", None, "a", 7), (-3, docs.first().text, None, "b", 1), (-3, docs.first().text, None, "b", 1), (None, "the of and to a in is it that was " * 3, "en", None, None)]
    df = docs.union(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "'x' as score", "1 as kept", "2 as fp", "'c' as copy", "3 as length", "4 as _row", "'u' as _all", "5 as lang_pred")
    extra = {"score": "x", "kept": 1, "fp": 2, "copy": "c", "length": 3, "_row": 4, "_all": "u", "lang_pred": 5}
    for _, stage in C.STAGES[:-1]:
        before, df = df.columns, C.materialise(stage(spark, df, sf), "odd")
        assert df.columns == before and all({c: r[c] for c in extra} == extra for r in df.collect())
    assert not {r.doc_id for r in df.collect()} & {-1, -2}
    assert C.pack(spark, df, sf).count() > 0


def test_repeated_rows_leave_one(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(3, "a b c d e"), (3, "a b c d e"), (None, "x y z"), (None, "x y z"), (4, "a b c d e"), (3, "other words here")]], schema)
    got = sorted((r.doc_id or 0, r.text) for r in C.near_dedup(spark, df, "").collect())
    assert got == [(0, "x y z"), (3, "a b c d e"), (3, "other words here")]


def test_empty_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([], schema)
    for _, stage in C.STAGES:
        df = C.materialise(stage(spark, df, ""), "none")
    assert df.count() == 0
