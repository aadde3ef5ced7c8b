import random

import numpy as np

from pyspark.sql import functions as F

from lodestack.llm import language_id as L
from lodestack.llm import quality_classifier as Q

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(300)
    odd = [None, "", "123 !? \n", "日本語のテキスト", "a", "the and of " * 40000]
    extra = spark.createDataFrame([(None if i == 4 else -i, t, None) for i, t in enumerate(odd)] + [(-1, "", None)], "doc_id long, text string, lang string")
    rows = L.predictions(docs.union(extra).withColumn("score", F.lit("x"))).where("doc_id <= 0 or doc_id is null").collect()
    assert sum(r.lang_pred == "und" and r.score == 0 for r in rows) == 4
    assert all(r.lang_pred in {"en", "de", "fr", "es", "und"} for r in rows)


def test_language_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.predictions(df).collect()] == [("und", 0.0)]
    assert L.predictions(df.limit(0)).collect() == []


def test_presence_is_the_set_of_grams():
    texts = ["abcab", "xyz a", "", "ab"]
    g = L.Grams(texts[:2])
    wanted = {t[i : i + n] for t in texts[:2] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert g.count == len(wanted)
    own = [len({t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} & wanted) for t in texts]
    assert g.presence(texts).sum(axis=1).tolist() == own


def test_scripts_beyond_a_small_alphabet():
    rng = random.Random(4)
    scripts = {"ja": (0x3041, 80), "zh": (0x4E00, 400), "ko": (0xAC00, 400), "ru": (0x430, 32), "el": (0x3B1, 24), "ar": (0x627, 30), "hi": (0x905, 50), "got": (0x10330, 26)}
    made = [(c, " ".join("".join(chr(start + rng.randrange(n)) for _ in range(4)) for _ in range(40))) for c, (start, n) in scripts.items() for _ in range(12)]
    held = [x for k, x in enumerate(made) if k % 3 == 0]
    model = L.fit_texts([t for k, (_, t) in enumerate(made) if k % 3], [c for k, (c, _) in enumerate(made) if k % 3])
    assert model.predict([t for _, t in held])[0] == [c for c, _ in held]


def test_both_numberings_agree(monkeypatch):
    texts = ["abcab \0é", "xyz a", "日本", ""]
    dense = L.Grams(texts[:3])
    monkeypatch.setattr(L, "DENSE", 0)
    sparse = L.Grams(texts[:3])
    assert sparse.table is None and dense.count == sparse.count and (dense.presence(texts) == sparse.presence(texts)).all()


def test_every_class_is_learned(spark):
    rows = [(k, f"l{k % 310}", f"w{chr(0x4E00 + k % 310)} x{chr(0x4E00 + k % 310)}") for k in range(620)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = L.fit(df, F.lit(True))
    assert len(model.classes) == 310 and model.predict([t for _, _, t in rows[:310]])[0] == [c for _, c, _ in rows[:310]]


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    for q in (0, 1):
        own = [r for r in rows if r.quality == q]
        assert sum(r.predicted == q for r in own) / len(own) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_sample_with_a_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE", 40)
    docs = spark.range(30).selectExpr("id doc_id", "concat('text ', id, ' of words') text")
    labels = spark.range(30).selectExpr("id doc_id", "cast(id % 2 as int) quality")
    hot = labels.orderBy(F.xxhash64(F.lit(5), F.col("doc_id"))).first().doc_id
    copies = spark.range(500).selectExpr(f"{hot}L doc_id", "concat('copy ', id % 100) text")
    model = Q.fit(docs.union(copies), labels, F.lit(True))
    assert sorted(model.labels.tolist()) == [0.0] * 15 + [1.0] * 15


def test_quality_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(None, "x"), (-1, None), (-2, ""), (-2, ""), (-3, " \n"), (-4, "w" * 100000)], "doc_id long, text string")
    rows = Q.scores(docs.select("doc_id", "text").limit(200).union(extra), labels).where("doc_id < 0 or doc_id is null").collect()
    assert len(rows) == 6 and all(r.score == 0 for r in rows if r.doc_id in (-1, -2, -3))


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "text here", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.scores(docs, none).collect()] == [0.5]
    assert Q.scores(docs.limit(0), none).collect() == []


def test_long_texts_in_windows(monkeypatch):
    text = "Ab c!\n 12 dé " * 40
    whole = Q.counts([text])
    monkeypatch.setattr(Q, "WINDOW", 7)
    assert (Q.counts([text]) == whole).all()
    model = L.fit_texts(["abc abd aé", "xyz xyw!"], ["a", "x"])
    want = model.scores([text.lower()])
    monkeypatch.setattr(L, "BATCH_CHARS", 9)
    assert all((a == b).all() for a, b in zip(model.scores([text.lower()]), want, strict=True)) and 0 < want[1][0] < 1


def grams(t):
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_kernel_ridge_against_sets_and_the_textbook_formula(monkeypatch):
    monkeypatch.setattr(L, "LANDMARKS_PER_CLASS", 4)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd é日" if k % 3 else "axyz 本") for _ in range(rng.randrange(3, 30))) + "a" for k in range(40)]
    labels = ["p" if k % 3 else "q" for k in range(40)]
    labels[5] = "r"
    model = L.fit_texts(texts, labels)
    classes = sorted(set(labels))
    marks = [t for c in classes for t in [t for t, own in zip(texts, labels) if own == c][:4]]
    kernel = lambda a, b: np.array([[len(grams(x) & grams(y)) / (len(grams(x)) * len(grams(y))) ** 0.5 for y in b] for x in a])
    weigh = np.diag([1 / labels.count(c) for c in labels])
    goal = np.array([[1.0 if c == own else -1.0 for c in classes] for own in labels])
    km, kn = kernel(marks, marks), kernel(texts, marks)
    alpha = np.linalg.solve(kn.T @ weigh @ kn + L.RIDGE / len(texts) * km, kn.T @ weigh @ goal)
    asked = [*texts[:10], "zzzz 日本日本", "quite another text a", "b"]
    found, known = model.scores(asked)
    assert np.abs(found - kernel(asked, marks) @ alpha).max() < 1e-4
    every = set().union(*map(grams, marks))
    assert np.allclose(known, [len(grams(t) & every) / len(grams(t)) for t in asked])
    label, score, _ = model.predict(asked)
    p = np.exp(L.SHARPNESS * found)
    assert label == [classes[k] for k in found.argmax(axis=1)] and np.allclose(score, p.max(axis=1) / p.sum(axis=1))


def test_no_letter_and_long_rows(spark):
    long = " ".join(f"кот{k % 37} пёс" for k in range(4000))
    rows = [(k, "ru", long + str(k)) for k in range(12)] + [(100 + k, "en", f"the cat {k} and dog") for k in range(12)] + [(500, "en", "the hot id and its copies")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = L.fit(df, F.lit(True))
    assert model.classes == ["en", "ru"]
    assert model.predict(["½ ² ①", "Ⅷ", "_1", "пёс и кот", "a dog"])[0] == ["und", "und", "und", "ru", "en"]


def test_quality_vote_against_plain_loops(spark):
    rng = random.Random(6)
    words = [["good", "clean", "prose", "日本", "текст"], ["BUY!!", "now$$", "$$$", "click", "買う"]]
    texts = [" ".join(rng.choice(words[k % 2] + words[rng.randrange(2)]) for _ in range(rng.randrange(2, 40))) for k in range(90)]
    labels = np.array([1 - k % 2 for k in range(90)])
    model = Q.fit_counts(Q.counts(texts), labels)
    asked = texts[:12] + ["click now", "prose", "unseen ωords"]
    got = model.score(asked)
    for text, own in zip(asked, got, strict=True):
        raw = Q.counts([text])[0].astype(float)
        x = np.log1p(raw) * model.idf
        for start, end, share in zip((0, *Q.ENDS), Q.ENDS, Q.SHARES):
            size = sum(v * v for v in x[start:end]) ** 0.5
            x[start:end] *= share / (size or 1)
        v = [sum(x[t] * model.basis[t, d] for t in np.flatnonzero(x)) for d in range(model.basis.shape[1])]
        size = sum(c * c for c in v) ** 0.5
        near = sorted(((sum(a * b for a, b in zip(v, row)) / size, int(q)) for row, q in zip(model.vectors, labels)), reverse=True)[: Q.NEIGHBOURS]
        weights = [max(c, 0) ** Q.SHARPNESS for c, _ in near]
        assert abs(own - sum(w * q for w, (_, q) in zip(weights, near)) / sum(weights)) < 1e-4


def test_quality_terms_tell_words_and_scripts_apart():
    texts = ["The cat sat, 12 days.", "Ein dog far, 47 mice.", "日本。 🔥🔥🔥", "中国。 🔥🔥🔥", "abc def"]
    c = Q.counts(texts)
    assert all((c[a] != c[b]).any() for a in range(5) for b in range(a))
    assert (c[0][: Q.ENDS[0]] == c[1][: Q.ENDS[0]]).all()  # of the same form


def test_quality_contradicting_and_repeated_labels(spark):
    docs = spark.range(20).selectExpr("id doc_id", "concat('text ', id) text")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(0, 1), (1, 0), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = Q.fit(docs, labels, F.lit(True))
    assert sorted(model.labels.tolist()) == [0.0] * 9 + [1.0] * 9
