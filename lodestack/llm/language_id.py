"""Language identification with a string kernel.

The kernel is the blended spectrum of n-gram presence: two texts are as close as the number of
distinct character 1-, 2- and 3-grams they share, over the geometric mean of how many each has.
Nyström landmarks make it finite: grams are those of the landmarks, a text is its kernel values
with the landmarks, and one-versus-rest kernel ridge regression is solved in that space. Because
every kernel value is a product of presence vectors, the weights fold into one matrix of grams by
classes, and scoring sums its rows over the grams that a text has. All distinct grams of a text
count for its length, also those that no landmark has; their share (known) tells how much of a
text the model has an opinion on, whatever the number of classes.

The fit takes a bounded sample: PER_CLASS rows of each class in expectation, twice that at most,
chosen by a hash of id and text; of a longer text it takes SAMPLE_CHARS characters from a place
that a hash gives. Every labelled class is learned, whatever its script or the length of its
texts. Scoring reads every whole text.

Edge cases: a text that is null or has no letter gets ``und`` with score 0; repeated rows are
scored alike, and teach once; ids may be null; other columns travel along, but lang_pred, score and known are replaced;
without any labelled row every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.shared import append_columns, crc_mod, materialise

PER_CLASS = 300
LANDMARKS_PER_CLASS = 24
SAMPLE_CHARS = 5_000
#: Class sizes of up to this many classes are broadcast.
BROADCAST_CLASSES = 20_000
#: Grams are numbered by a table of every possible one up to this size, else by a search among those that occur.
DENSE = 1 << 23
RIDGE = 0.05
SHARPNESS = 6.0
#: Characters that are arrays at one time.
BATCH_CHARS = 1 << 18
#: Grams that are looked up at one time.
BLOCK = 1024
LETTER = regex.compile(r"\p{L}")


class Grams:
    """Numbers of the n-grams of a set of texts, over all their characters; any other character is one that no gram has."""

    def __init__(self, texts: list[str]):
        chars = np.unique(np.concatenate([np.unique(_points(t)) for t in texts]))
        self.size = a = len(chars) + 1  # 0: any other character
        dense = a + a * a + a * a * a <= DENSE
        self.code = np.zeros(int(chars[-1]) + 2, np.int32 if dense else np.int64)
        self.code[chars] = np.arange(1, a)
        self.codes, held = np.zeros(0, self.code.dtype), []
        for k, t in enumerate(texts):
            held.append(np.unique(self._grams(t)))
            if k + 1 == len(texts) or sum(map(len, held)) > 1 << 22:
                self.codes, held = np.unique(np.concatenate([self.codes, *held])), []
        self.count = len(self.codes)
        self.table = None
        if dense:
            self.table = np.full(a + a * a + a * a * a, self.count, np.int32)  # the last number: no gram of the landmarks
            self.table[self.codes] = np.arange(self.count)

    def _grams(self, text: str) -> np.ndarray:
        """Codes of all grams of a text."""
        a, c = self.size, self.code[np.minimum(_points(text), len(self.code) - 1)]
        two = c[:-1] * a + c[1:]
        three = two[:-1] * a + c[2:] if len(c) > 2 else two[:0]
        return np.concatenate((c, two + a, three + a + a * a))

    def _numbers(self, codes: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[codes]
        at = np.minimum(np.searchsorted(self.codes, codes), self.count - 1)
        return np.where(self.codes[at] == codes, at, self.count)

    def read(self, text: str) -> tuple[np.ndarray, int]:
        """Numbers of the grams that a text has, in order, and how many distinct grams it has in all; a long one is read in windows that overlap by two characters."""
        seen, other = np.zeros(self.count + 1, bool), np.zeros(0, np.uint64)
        for at in range(0, len(text), BATCH_CHARS - 2):
            part = text[at : at + BATCH_CHARS]
            numbers = self._numbers(self._grams(part))
            seen[numbers] = True
            new = numbers == self.count
            if new.any():
                other = np.union1d(other, _names(part)[new])
        known = np.flatnonzero(seen[: self.count])
        return known, len(known) + len(other)

    def within(self, text: str) -> np.ndarray:
        return self.read(text)[0]

    def presence(self, texts: list[str]) -> np.ndarray:
        """A row of 0 and 1 for each text."""
        found = np.zeros((len(texts), self.count), np.float32)
        for row, t in zip(found, texts, strict=True):
            row[self.within(t)] = 1
        return found


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _names(text: str) -> np.ndarray:
    """Numbers of all grams of a text that depend on nothing but the gram, in the order of Grams."""
    p = _points(text).astype(np.uint64) + 1
    two = p[:-1] << 21 | p[1:]
    return np.concatenate((p, two, two[:-1] << 21 | p[2:] if len(p) > 2 else two[:0]))


@dataclass
class Model:
    classes: list[str]
    grams: Grams | None
    weights: np.ndarray | None  # grams by classes

    def scores(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Regression values, a row for each text, and the share of its grams that is known."""
        out, known = [], []
        for text in texts:
            seen, size = self.grams.read(text)
            total = sum(self.weights[seen[at : at + BLOCK]].sum(axis=0, dtype=np.float64) for at in range(0, max(1, len(seen)), BLOCK))
            out.append(total / np.sqrt(max(size, 1)))
            known.append(len(seen) / max(size, 1))
        return np.array(out), np.array(known)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Class, score from 0 to 1 and known share of each text."""
        label, score, known = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.classes:
            return label, score, known
        todo = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
        for at in range(0, len(todo), 128):
            own = todo[at : at + 128]
            s, known[own] = self.scores(texts[k].lower() for k in own)
            p = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)))
            score[own] = p.max(axis=1) / p.sum(axis=1)
            for k, b in zip(own, p.argmax(axis=1).tolist(), strict=True):
                label[k] = self.classes[b]
        return label, score, known


def fit_texts(texts: list[str], labels: list[str]) -> Model:
    """Kernel ridge regression on labelled texts; the first texts of each class are its landmarks."""
    pairs = [(t.lower(), c) for t, c in zip(texts, labels, strict=True) if t and LETTER.search(t)]
    by_class: dict[str, list[str]] = {}
    for t, c in pairs:
        by_class.setdefault(c, []).append(t)
    classes = sorted(by_class)
    if not classes:
        return Model([], None, None)
    marks = [t for c in classes for t in by_class[c][:LANDMARKS_PER_CLASS]]
    grams = Grams(marks)
    seen = [grams.within(t) for t in marks]
    norm = 1 / np.sqrt(np.maximum([len(ids) for ids in seen], 1))
    flat = np.concatenate(seen)
    order = np.argsort(flat, kind="stable")
    holders = np.repeat(np.arange(len(marks)), [len(ids) for ids in seen])[order]  # landmarks of each gram, gram by gram
    ends = np.searchsorted(flat[order], np.arange(grams.count), side="right")
    sizes = np.diff(ends, prepend=0)

    def kernel(ids: np.ndarray, size: int) -> np.ndarray:
        shared = np.zeros(len(marks), np.int64)
        for at in range(0, len(ids), BLOCK):
            some = ids[at : at + BLOCK]
            n = sizes[some]
            shared += np.bincount(holders[np.repeat(ends[some] - np.cumsum(n), n) + np.arange(n.sum())], minlength=len(marks))
        return shared * norm / np.sqrt(max(size, 1))

    values, vectors = np.linalg.eigh(np.array([kernel(ids, len(ids)) for ids in seen]))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # the landmark kernel to the power -1/2, up to a rotation
    number = {c: k for k, c in enumerate(classes)}
    own = np.array([number[c] for _, c in pairs])
    even = 1.0 / np.bincount(own, minlength=len(classes))[own][:, None]  # classes weigh the same
    square, right = np.zeros((len(marks), len(marks))), np.zeros((len(marks), len(classes)))
    for k in range(0, len(pairs), 256):
        phi = np.array([kernel(*grams.read(t)) for t, _ in pairs[k : k + 256]]) @ root
        goal = np.where(own[k : k + 256, None] == np.arange(len(classes)), 1.0, -1.0)
        square += phi.T @ (phi * even[k : k + 256])
        right += phi.T @ (goal * even[k : k + 256])
    pull = root @ np.linalg.solve(square + RIDGE / len(pairs) * np.eye(len(marks)), right) * norm[:, None]
    weights = np.zeros((grams.count, len(classes)), np.float32)
    for ids, row in zip(seen, pull, strict=True):
        weights[ids] += row.astype(np.float32)
    return Model(classes, grams, weights)


def fit(df: DataFrame, where: Column) -> Model:
    """Fit on a sample of df (doc_id, text, lang) within a condition."""
    usable = df.where(where & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = materialise(usable.groupBy("lang").count(), "classes")
    classes = sizes.count()
    if not classes:
        return Model([], None, None)
    if classes <= BROADCAST_CLASSES:
        sizes = F.broadcast(sizes)
    name = lambda seed: F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    drawn = F.pmod(name(8), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.least(F.lit(1.0), F.lit(float(PER_CLASS)) / F.col("count"))
    place = F.pmod(name(10), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    some = usable.select("doc_id", "lang", "text").join(sizes, "lang").where(drawn < share)
    some = some.select("lang", F.substring("text", place, F.lit(SAMPLE_CHARS)).alias("text"), name(9).alias("h")).dropDuplicates(["lang", "h"])
    best = Window.partitionBy("lang").orderBy("h")
    rows = some.withColumn("n", F.row_number().over(best)).where(F.col("n") <= 2 * PER_CLASS).orderBy("h", "lang").collect()
    return fit_texts([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(df: DataFrame, model: Model) -> DataFrame:
    """df with lang_pred, score and known."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        label, score, known = shared.value.predict(texts)
        return {"lang_pred": pa.array(label, pa.string()), "score": pa.array(score), "known": pa.array(known)}

    return append_columns(df, {"lang_pred": "string", "score": "double", "known": "double"}, run)


def held_out() -> Column:
    return crc_mod("doc_id", 4) == 2


def predictions(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs, ~held_out())
    return identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
