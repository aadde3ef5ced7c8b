"""A ledger of quality rules: every rule is evaluated once, policies come later.

``ledger`` reads each whole text once and stores what was measured together with one bit per
failed rule. A policy is a mask of rules under a version name: applying it, or changing it, is a
bitwise AND over the stored ledger and never a second look at the texts. ``ablation`` counts rows
by bit pattern (at most 2 to the number of rules, combined before the shuffle) and derives from
those what each rule alone rejects.

Edge cases: a null or empty text has no words and fails ``few_words``; repeated rows keep a row
each; ids may be null; other columns travel along,
but those named like a measure are replaced; an empty table gives an empty ledger. Very long
texts are measured whole, with arrays in place of dictionaries.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.shared import append_columns

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: From so many words on, windows are compared as numbers.
MANY_WORDS = 1 << 17

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_stutter"]
#: Rules by bit; each is true where a document fails. The SQL is common to Spark and DuckDB.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "short_words": "n_words > 0 AND word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "100 * n_upper > 40 * word_chars",
    "stutter": "100 * n_stutter > 30 * n_words",
}
BASE = ("few_words", "repeated_windows")
POLICIES = {"base": BASE, "v1": (*BASE, "symbols", "repeated_lines", "capitals", "stutter"), "v2": tuple(RULES)}


def mask_of(rules: tuple[str, ...] | list[str]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five that the text holds at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) < MANY_WORDS:
        windows = [*zip(words, words[1:], words[2:], words[3:], words[4:])]
        if len(set(windows)) == n:
            return 0
        count = Counter(windows)
        hit = np.fromiter((count[w] > 1 for w in windows), bool, n)
    else:
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        key = ids[:n]
        for k in range(1, WINDOW):
            key = np.unique(key * len(index) + ids[k : k + n], return_inverse=True)[1]
        hit = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + n] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for a text."""
    text = text or ""
    low = text.lower()
    words = _words(text)
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    if len(low) == len(text):
        upper = int((np.frombuffer(text.encode("utf-32-le"), np.uint32) != np.frombuffer(low.encode("utf-32-le"), np.uint32)).sum())
    else:
        upper = sum(c != c.lower() for c in text)
    return (
        len(words),
        len(text) - sum(map(text.count, SEPARATORS)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        upper,
        sum(map(eq, words, words[1:])),
    )


def _words(text: str) -> list[bytes]:
    """Runs of bytes other than the six separators, which are what bytes.split() cuts at."""
    return text.encode().split()


def ledger(df: DataFrame) -> DataFrame:
    """df with MEASURES (long) of its texts and failed (long, a bit per rule of RULES)."""

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        rows = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
        return {c: pa.array(rows[:, k]) for k, c in enumerate(MEASURES)}

    measured = append_columns(df, dict.fromkeys(MEASURES, "long"), run)
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    return measured.withColumn("failed", sum(bits[1:], bits[0]).cast("long"))


def apply_policy(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """Add base_failed and kept to a ledger."""
    base, own = mask_of(BASE), mask_of(POLICIES[policy])
    return entries.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(base)) != 0).withColumn("kept", F.col("failed").bitwiseAND(F.lit(base | own)) == 0)


def ablation(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: rows that fail it, that fail it alone, and that are kept without it."""
    own = mask_of(POLICIES[policy])
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(own)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(RULES) if own >> k & 1])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def judged(df: DataFrame, policy: str = "v2") -> DataFrame:
    return apply_policy(ledger(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), policy).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "n_lines", "n_upper", "n_stutter")


def _sql() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
    twice AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
    covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT g.r, unnest(range(i, i + 5)) AS p FROM g JOIN twice ON g.r = twice.r AND g.g = twice.g) GROUP BY r),
    m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
                 CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(lines) AS BIGINT) AS n_lines,
                 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
                 CAST(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper,
                 CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_stutter
          FROM w LEFT JOIN covered ON w.r = covered.r),
    f AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (failed & {mask_of(BASE)}) <> 0 AS base_failed, (failed & {mask_of(BASE) | mask_of(POLICIES["v2"])}) = 0 AS kept,
           failed, n_lines, n_upper, n_stutter
    FROM f
    """


SQL = _sql()
