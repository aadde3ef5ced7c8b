"""Quality scores by nearest-neighbour voting in a latent semantic space.

Terms come in three blocks, each hashed into columns of its own: words in lower case; 3-grams of
characters in lower case, whatever their script; and what shows form, 1- to 3-grams of character
shapes (lower case, capital, digit, space, line end, each punctuation mark) with a few terms for
how often words and lines repeat and how long words are. Term weights (logarithmic counts times
inverse document frequency, each block brought to its share of the length) of a sample of labelled
documents are reduced by a truncated singular value decomposition. The labelled vectors are
broadcast: SAMPLE rows of DIMS numbers at most, whatever the corpus holds. Every document is folded
in and compared with all of them, in blocks, by exact cosine products; its nearest ones vote with
their similarity.

The fit takes at most SAMPLE / 2 rows of each label, chosen by a hash of their id. Scoring reads
every whole text.

Edge cases: a null text, or one without a word, scores 0; without labelled rows every other text
scores 0.5; an id that is labelled both 0 and 1 teaches nothing, one that repeats with one label
counts once, with the text of the smallest hash; repeated rows score alike; ids may be null; other
columns travel along, but score is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.shared import append_columns, crc_mod

SAMPLE = 3000
#: Columns of the blocks (form, words, characters), and their shares of a row's length.
WIDTHS = (2048, 2048, 2048)
SHARES = (1.0, 0.5, 0.5)
TERMS = sum(WIDTHS)
ENDS = tuple(sum(WIDTHS[: k + 1]) for k in range(3))
DIMS = 64
NEIGHBOURS = 25
SHARPNESS = 6
BLOCK = 128
#: Characters that are arrays at one time.
WINDOW = 1 << 18

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHAPES = 6 + len(_PUNCTUATION)
_SPECIAL = 64  # terms that are not n-grams
_STEPS = 8


def _shape(c: str) -> int:
    if c == "\n":
        return 4
    if c.isspace():
        return 3
    if c.isdigit():
        return 2
    if c in _PUNCTUATION:
        return 6 + _PUNCTUATION.index(c)
    if c.isalpha():
        return 1 if c != c.lower() else 0
    return 5


_TABLE = np.array([_shape(chr(k)) for k in range(0x600)], np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _shapes(text: str) -> np.ndarray:
    points = _points(text)
    return _TABLE[np.where(points < len(_TABLE), points, 97)]


def _specials(text: str, words: list[str]) -> list[int]:
    """Terms for repetition and lengths, in steps."""
    lines = [x for x in text.split("\n") if x.strip()]
    step = lambda share: min(_STEPS - 1, int(share * _STEPS))
    n = max(1, len(words))
    return [
        step(len(set(words)) / n),
        _STEPS + step(len(set(zip(words, words[1:]))) / max(1, n - 1)),
        2 * _STEPS + step(len(set(lines)) / max(1, len(lines))),
        3 * _STEPS + step(min(0.99, sum(map(len, words)) / n / 16)),
    ]


def counts(texts: list[str]) -> np.ndarray:
    """Terms counted, a row for each text."""
    room = WIDTHS[0] - _SPECIAL
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        for at in range(0, len(text), WINDOW):
            s = _shapes(text[at : at + WINDOW + 2])
            two = s[:-1] * SHAPES + s[1:]
            three = two[:-1] * SHAPES + s[2:]
            grams = np.concatenate((s[:WINDOW], two[:WINDOW] + SHAPES, three[:WINDOW] + SHAPES * (SHAPES + 1)))
            row[:room] += np.bincount((grams * 2654435761 >> 7) % room, minlength=room)
        low, words = text.lower(), text.split()
        row[[room + t for t in _specials(text, words)]] = 1 + len(text) / 8
        for word, n in Counter(low.split()).items():
            row[ENDS[0] + zlib.crc32(word.encode("utf-8", "surrogatepass")) % WIDTHS[1]] += n
        for at in range(0, len(low), WINDOW):
            c = _points(low[at : at + WINDOW + 2]).astype(np.uint64)
            grams = ((c[:-2] * 0x9E3779B97F4A7C15 + c[1:-1]) * 0x9E3779B97F4A7C15 + c[2:]) * 0x9E3779B97F4A7C15 >> 40
            row[ENDS[1] :] += np.bincount((grams % WIDTHS[2]).astype(np.int64), minlength=WIDTHS[2])
    return out


@dataclass
class Model:
    idf: np.ndarray | None
    basis: np.ndarray | None  # terms by dimensions
    vectors: np.ndarray | None  # labelled rows by dimensions, of length one
    labels: np.ndarray | None

    def fold(self, counted: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counted, self.idf) @ self.basis)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """From 0 to 1, higher where label 1 is likelier."""
        out = np.zeros(len(texts))
        todo = [k for k, t in enumerate(texts) if t and not t.isspace()]
        if self.vectors is None:
            out[todo] = 0.5
            return out
        near = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(todo), BLOCK):
            own = todo[at : at + BLOCK]
            cosine = self.fold(counts([texts[k] for k in own])) @ self.vectors.T
            pick = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
            weight = np.maximum(np.take_along_axis(cosine, pick, axis=1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            out[own] = np.where(total > 0, (weight * self.labels[pick]).sum(axis=1) / np.where(total > 0, total, 1), self.labels.mean())
        return np.clip(out, 0, 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(size > 0, size, 1)).astype(np.float32)


def _weighted(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counted) * idf
    for start, end, share in zip((0, *ENDS), ENDS, SHARES):
        size = np.linalg.norm(out[:, start:end], axis=1, keepdims=True)
        out[:, start:end] *= share / np.where(size > 0, size, 1)
    return out.astype(np.float32, copy=False)


def fit_counts(counted: np.ndarray, labels: np.ndarray) -> Model:
    if not len(labels):
        return Model(None, None, None, None)
    idf = (np.log((1 + len(counted)) / (1 + (counted > 0).sum(axis=0))) + 0.1).astype(np.float32)
    weighted = _weighted(counted, idf)
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(weighted.T @ rng.standard_normal((len(labels), DIMS + 16), np.float32))[0]
    for _ in range(6):  # subspace iteration to the leading right singular vectors
        basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
    turn = np.linalg.svd(weighted @ basis, full_matrices=False)[2]
    basis = (basis @ turn.T)[:, :DIMS].astype(np.float32)
    return Model(idf, basis, _unit(weighted @ basis), labels.astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, where: Column) -> Model:
    """Fit on labelled rows (doc_id, text; doc_id, quality) within a condition on doc_id."""
    drawn = labels.where(where & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    drawn = drawn.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other")).where("quality = _other").drop("_other")
    drawn = drawn.withColumn("h", F.xxhash64(F.lit(5), F.col("doc_id")))
    half = [drawn.where(F.col("quality") == q).orderBy("h", "doc_id").limit(SAMPLE // 2) for q in (0, 1)]
    ids = half[0].union(half[1])
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")  # SAMPLE ids at most
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("t"), "text", "quality", "h")).alias("one")).select("one.*")  # a repeated id counts once

    def run(batches):
        for batch in batches:
            packed = [_sparse(row) for at in range(0, batch.num_rows, BLOCK) for row in counts(batch.column(0).slice(at, BLOCK).to_pylist())]
            yield pa.RecordBatch.from_pydict({"terms": pa.array(packed, pa.binary()), "quality": batch.column(1), "h": batch.column(2)})

    got = rows.select("text", F.col("quality").cast("int").alias("quality"), "h").mapInArrow(run, "terms binary, quality int, h long").orderBy("h", "terms").limit(SAMPLE).collect()
    table = np.zeros((len(got), TERMS), np.float32)
    for k, r in enumerate(got):
        at, n = np.frombuffer(r["terms"], np.float32).reshape(2, -1)
        table[k, at.astype(int)] = n
    return fit_counts(table, np.array([r["quality"] for r in got]))


def _sparse(row: np.ndarray) -> bytes:
    at = np.flatnonzero(row)
    return np.stack([at.astype(np.float32), row[at]]).tobytes()


def score(df: DataFrame, model: Model) -> DataFrame:
    """df with score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return append_columns(df, {"score": "double"}, lambda texts: {"score": pa.array(shared.value.score(texts))})


def held_out() -> Column:
    return crc_mod("doc_id", 3) == 1


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, score all: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, ~held_out())
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
