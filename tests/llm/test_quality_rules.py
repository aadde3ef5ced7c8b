import random
import re
from collections import Counter

from lodestack.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(win)
    hit = {i + k for i, x in enumerate(win) if count[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit), sum(c != c.lower() for c in text), sum(a == b for a, b in zip(w, w[1:])))


def texts():
    rng = random.Random(2)
    made = [" ".join(rng.choice("ab#") for _ in range(rng.randint(0, 30))) for _ in range(80)]
    made += ["\n".join(rng.choice(["x y", " ", "", "z", "z "]) for _ in range(12)) for _ in range(20)]
    return [None, "", " \x0b\x0c\r\n", "one", "a\x1cb c\x85d e\xa0f", "ÀÉ İx ΣΑΣ", "a b c d e " * 2, *made]


def test_measures_against_brute_force(monkeypatch):
    for t in texts():
        assert Q.measure(t) == brute(t), t
    monkeypatch.setattr(Q, "MANY_WORDS", 0)
    for t in texts():
        assert Q.measure(t) == brute(t), t


def test_very_long_text():
    assert Q.measure("lorem ipsum " * 200_000)[5] == 400_000


def test_ledger_policies_and_ablation(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "a b", "x"), (None, "a b", "x")]
    led = Q.ledger(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).cache()
    assert led.count() == len(rows)
    by = {v: Q.apply_policy(led, v).where("kept").count() for v in Q.POLICIES}
    assert by["base"] >= by["v1"] >= by["v2"]
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in Q.apply_policy(led).collect())
    failed = [r.failed for r in led.collect()]
    for r in Q.ablation(led, "v2").collect():
        bit = 1 << list(Q.RULES).index(r.rule)
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(f & bit > 0 for f in failed), failed.count(bit), sum(f & ~bit == 0 for f in failed))


def test_empty(spark):
    assert Q.judged(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_separates_labelled_rows(spark, sf):
    got = Q.judged(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in got if r.quality == 1)
