"""SimHash near-duplicates found with a hierarchical index in Gray order.

Distinct fingerprints are sorted by Gray rank (so that neighbours share long bit patterns) and
cut into leaves of bounded size. A node of the index is a mask of the bits that all fingerprints
below it share and the pattern of those bits; every upper level merges sixteen nodes. The search
joins the index with itself from the root downwards: two nodes whose shared bits already differ
in more than the allowed number of places are pruned with all that is below them. Leaf pairs that
survive go through the same pruning on small groups inside the leaf, then through the exact
comparison. A leaf pair reports a spanning forest of its links, not every link, which leaves the
components as they are and keeps a group of many near copies from being written out as pairs.

Edge cases: null and empty texts have fingerprint zero and link like any other; texts of fewer
words than a shingle are one shingle; repeated rows keep a row each; equal ids of different texts
are different nodes; ids may be null; other columns are ignored by fingerprints().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.components import connected_components
from lodestack.llm.shared import ROWS, append_columns, as_bytes, hashable, materialise, partitions, shield

LEAF = 8192
GROUP = 16
#: Bits of a leaf's key for its place in its range; a range holds 16 leaves by design, and its last leaf any rest.
SEQ_BITS = 12
#: Index leaves are broadcast up to this number of fingerprints (8 bytes each: 32 MB), else joined by a shuffle.
BROADCAST_FINGERPRINTS = 4_000_000
#: Rows that stay are broadcast up to this number (16 bytes each before hashing), else joined by a shuffle.
BROADCAST_KEEPERS = 500_000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def hashed(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles in their order, repeats included, CHUNK at a time; nothing without a word."""
    words = (text or b"").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= shingle:
        yield np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    ends = starts[shingle:] - 1
    n, digest = len(ends), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        a, b = starts[at : min(at + CHUNK, n)].tolist(), ends[at : at + CHUNK].tolist()
        yield np.fromiter([digest(joined[i:j], 42) for i, j in zip(a, b, strict=True)], np.uint64, len(b))


def majority(chunks: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes; 0 without a hash."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in chunks:
        for at in range(0, len(hashes), CHUNK):
            counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without a word."""
    return majority(hashed(text, shingle))


def fingerprints(df: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = np.array([fingerprint(t, shingle) for t in as_bytes(part.column(1))], np.uint64)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "fp": pa.array(found.view(np.int64))})

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(bits: Column) -> Column:
    """Place of a bit pattern in the reflected Gray sequence, ordered as a signed long."""
    for step in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, step))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def _shared_bits(fps: np.ndarray) -> tuple[int, int]:
    mask = ~np.bitwise_or.reduce(fps ^ fps[0])
    return int(mask.view(np.int64)), int((fps[0] & mask).view(np.int64))


def leaves(distinct: DataFrame, n: int, leaf: int = LEAF) -> DataFrame:
    """key, mask, pattern and fps (packed) of leaves in Gray order; keys of one parent share key >> 4."""
    parts = max(1, -(-n // (leaf * GROUP)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, np.array([], np.uint64)

        def row(fps: np.ndarray, k: int) -> pa.RecordBatch:
            mask, pattern = _shared_bits(fps)
            return pa.RecordBatch.from_pydict({"key": pa.array([(part << SEQ_BITS) + k], pa.int64()), "mask": pa.array([mask], pa.int64()), "pattern": pa.array([pattern], pa.int64()), "fps": pa.array([fps.tobytes()], pa.binary())})

        for batch in batches:
            held = np.concatenate((held, batch.column(0).to_numpy().view(np.uint64)))
            while len(held) >= leaf and seq + 1 < 1 << SEQ_BITS:
                yield row(held[:leaf], seq)
                held, seq = held[leaf:], seq + 1
        if len(held):
            yield row(held, seq)

    ordered = distinct.select("fp", gray_rank(F.col("fp")).alias("_rank")).repartitionByRange(parts, "_rank").sortWithinPartitions("_rank")
    return ordered.select("fp").mapInArrow(run, "key long, mask long, pattern long, fps binary")


def _parents(nodes: DataFrame, bits: int) -> DataFrame:
    agree = F.bitwise_not(F.bit_and("pattern").bitwiseXOR(F.bit_or("pattern")))
    up = nodes.groupBy(F.shiftright("key", bits).alias("key")).agg(F.bit_and("mask").bitwiseAND(agree).alias("mask"), F.bit_and("pattern").alias("pattern"))
    return up.select("key", "mask", F.col("pattern").bitwiseAND(F.col("mask")).alias("pattern"))


def leaf_pairs(index: DataFrame, most_bits: int) -> DataFrame:
    """Pairs a <= b of leaf keys that the upper nodes do not prune."""
    top = index.agg(F.max("key")).first()[0]
    level, levels = index.select("key", "mask", "pattern"), []
    while top is not None:
        levels.append(level)
        if not top:
            break
        level, top = _parents(level, 4), top >> 4
    if not levels:
        return index.select(F.col("key").alias("a"), F.col("key").alias("b"))
    pairs = levels[-1].select(F.col("key").alias("a"), F.col("key").alias("b"))
    for nodes in reversed(levels[:-1]):
        left = nodes.select(F.col("key").alias("ka"), F.shiftright("key", 4).alias("a"), F.col("mask").alias("ma"), F.col("pattern").alias("pa"))
        right = nodes.select(F.col("key").alias("kb"), F.shiftright("key", 4).alias("b"), F.col("mask").alias("mb"), F.col("pattern").alias("pb"))
        differ = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb")).bitwiseAND(F.col("ma")).bitwiseAND(F.col("mb")))
        pairs = pairs.join(left, "a").join(right, "b").where((F.col("ka") <= F.col("kb")) & (differ <= most_bits)).select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    return pairs


def _groups(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks and patterns of the groups of sixteen in a leaf."""
    starts = np.arange(0, len(fps), GROUP)
    first = np.repeat(fps[starts], np.diff(np.append(starts, len(fps))))
    mask = ~np.bitwise_or.reduceat(fps ^ first, starts)
    return mask, fps[starts] & mask


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def forest(a: np.ndarray, b: np.ndarray | None, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two leaves, or inside one (b None)."""
    other = a if b is None else b
    ma, pa_ = _groups(a)
    mb, pb = _groups(other)
    every, shift = (a, 0) if b is None else (np.concatenate((a, b)), len(a))
    n, label, found_i, found_j, held = len(every), None, [], [], 0
    lane = np.arange(GROUP)

    def fold() -> None:
        nonlocal label, found_i, found_j, held
        own = np.arange(n) if label is None else label
        label = _stars(n, np.concatenate([np.arange(n), *found_i]), np.concatenate([own, *found_j]))
        found_i, found_j, held = [], [], 0

    for row in range(0, len(ma), 64):
        near = np.bitwise_count((pa_[row : row + 64, None] ^ pb) & ma[row : row + 64, None] & mb) <= most_bits
        ga, gb = np.nonzero(near)
        ga += row
        if b is None:
            keep = ga <= gb
            ga, gb = ga[keep], gb[keep]
        for at in range(0, len(ga), 2048):
            i = (ga[at : at + 2048, None] * GROUP + lane)[:, :, None]
            j = (gb[at : at + 2048, None] * GROUP + lane)[:, None, :]
            near = np.bitwise_count(a[np.minimum(i, len(a) - 1)] ^ other[np.minimum(j, len(other) - 1)]) <= most_bits
            near &= (i < len(a)) & (j < len(other))
            if b is None:
                near &= i < j
            x, y, z = np.nonzero(near)
            if len(x):
                found_i.append(i[x, y, 0])
                found_j.append(j[x, 0, z] + shift)
                held += len(x)
                if held > 2_000_000:
                    fold()
    if held:
        fold()
    if label is None:
        return every[:0], every[:0]
    linked = np.flatnonzero(label != np.arange(n))
    return every[linked], every[label[linked]]


def links(distinct: DataFrame, n: int, most_bits: int = 3, leaf: int = LEAF) -> DataFrame:
    """src, dst: links of distinct fingerprints (column fp, n rows) that join all that are near; not every link."""
    spark = distinct.sparkSession
    index = materialise(leaves(distinct, n, leaf), "leaves")
    data = index.select("key", "fps")
    if n <= BROADCAST_FINGERPRINTS:
        data = F.broadcast(data)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                fa = np.frombuffer(x.as_py(), np.uint64)
                i, j = forest(fa, None if a == b else np.frombuffer(y.as_py(), np.uint64), most_bits)
                yield pa.RecordBatch.from_pydict({"src": pa.array(i.view(np.int64)), "dst": pa.array(j.view(np.int64))})

    pairs = leaf_pairs(index, most_bits).repartition(4 * partitions(spark), "a", "b")
    return (
        pairs.join(data.select(F.col("key").alias("a"), F.col("fps").alias("x")), "a")
        .join(data.select(F.col("key").alias("b"), F.col("fps").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(compare, "src long, dst long")
    )


def classes(distinct: DataFrame, most_bits: int = 3, leaf: int = LEAF) -> DataFrame:
    """fp and label of distinct fingerprints (a written table with column fp); one label for all that links reach."""
    found = connected_components(links(distinct, distinct.count(), most_bits, leaf)).select(F.col("node").alias("fp"), "label")
    return distinct.join(found, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(df: DataFrame, shingle: int = 3, most_bits: int = 3, leaf: int = LEAF) -> DataFrame:
    """One row per row of df: doc_id, fp and component_id, the smallest doc_id that links reach."""
    fps = materialise(fingerprints(df, shingle), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("_low")), "distinct")
    labelled = classes(distinct, most_bits, leaf)
    lowest = labelled.groupBy("label").agg(F.min("_low").alias("component_id"))
    return fps.join(labelled.join(lowest, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def survivors(df: DataFrame, shingle: int = 3, most_bits: int = 3, leaf: int = LEAF) -> DataFrame:
    """df with one row of each component: the smallest doc_id, then the smallest row hash.

    Only ids, hashes and fingerprints are shuffled. The rows that stay are found by a semi join,
    whose keys are broadcast up to BROADCAST_KEEPERS of them.
    """
    own, restore = shield(df, "_row", "_id", "_key")
    row = F.xxhash64(F.lit(0), *hashable(own)).alias("_row")
    keyed = own.select("*", row)
    texts = own.select("doc_id", "text", row)
    fps = append_columns(texts, {"fp": "long"}, lambda some: {"fp": pa.array(np.array([fingerprint(t.encode() if t else b"", shingle) for t in some], np.uint64).view(np.int64))})
    fps = materialise(fps.select("doc_id", "_row", "fp"), "fingerprints")
    distinct = materialise(fps.select("fp").distinct(), "distinct")
    first = F.min(F.struct("doc_id", "_row")).alias("_first")
    keepers = fps.groupBy("fp").agg(first).join(classes(distinct, most_bits, leaf), "fp").groupBy("label").agg(F.min("_first").alias("_first"))
    return restore(kept_rows(keyed, fps, keepers))


def kept_rows(keyed: DataFrame, narrow: DataFrame, keepers: DataFrame) -> DataFrame:
    """Rows of keyed whose (doc_id, _row) is the _first of a keeper, repeated rows once; narrow: a written table of all doc_id and _row."""
    keepers = materialise(keepers.select(F.col("_first.doc_id").alias("_id"), F.col("_first._row").alias("_key")), "keepers")
    n = keepers.count()
    some = F.broadcast(keepers) if n <= BROADCAST_KEEPERS else keepers
    same = lambda d: (d["_row"] == some["_key"]) & d["doc_id"].eqNullSafe(some["_id"])
    kept = keyed.join(some, same(keyed), "left_semi")
    if narrow.join(some, same(narrow), "left_semi").count() > n:  # whole rows repeat
        kept = kept.dropDuplicates(["doc_id", "_row"])
    return kept
