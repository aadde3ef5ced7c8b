"""SimHash near-dedup of texts whose word shingles have a Jaccard similarity of 0.8 or more.

Such texts lie about ten of 64 bits apart, where the Gray-order index prunes nothing. So candidates
come from two sides, and each one is checked exactly on the whole shingle sets:

* the Gray-order index over SimHash fingerprints of the distinct shingles, at a few bits;
* blocks of texts that share a band of MinHash values. BANDS bands of PER_BAND values miss a pair at
  0.8 with a probability of 0.008, a closer pair with less; within a block nothing is left out.

Texts of equal sets are one node. In a block every node is first compared with the block's smallest
node, which is linear. What these links leave in several components is settled inside the block:
nodes outside the block's largest component meet all others, in pairs of sub-blocks of bounded size
and bytes, closest fingerprints first, and a pair that is already joined is skipped; a sub-block pair
reports a spanning forest. Fingerprints over FAR bits apart are not compared there (one pair at 0.8 in
about a million is). Comparing grows with the square of a block only where its texts are unlike.

Edge cases: null and empty texts and those without a word are equal; texts of fewer words than a
shingle are one shingle; repeated rows leave one; ids may be null or repeat; all other columns are
kept, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import simhash
from lodestack.llm.components import connected_components
from lodestack.llm.shared import append_columns, as_bytes, hashable, materialise, shield

BANDS = 16
PER_BAND = 6
#: Bits beyond which fingerprints of a block are not compared: 0.8 puts them 9.7 bits apart, with a deviation of 2.9.
FAR = 24
#: Nodes and bytes of text of a sub-block.
BLOCK = 256
BLOCK_BYTES = 8 << 20
#: Shingles whose MinHash values are made at once.
STEP = 2048

_random = np.random.default_rng(5)
_MULTIPLY, _ADD, _FOLD = (_random.integers(0, 1 << 64, BANDS * PER_BAND, np.uint64) | np.uint64(1) for _ in range(3))


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of a text's word shingles, in order."""
    found = [np.unique(some) for some in simhash.hashed(text, shingle)]
    if len(found) < 2:
        return found[0] if found else np.array([], np.uint64)
    return np.unique(np.concatenate(found))


def bands(found: np.ndarray) -> np.ndarray:
    """A key per band, from the smallest values of PER_BAND hash functions each."""
    low = np.full(BANDS * PER_BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), STEP):
        low = np.minimum(low, (found[at : at + STEP, None] * _MULTIPLY + _ADD).min(axis=0))
    return (low * _FOLD).reshape(BANDS, PER_BAND).sum(axis=1, dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)) * (1 - 1e-9):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) >= least


def signatures(texts: DataFrame, shingle: int) -> DataFrame:
    """The rows with node (digest of the shingle set), fp (SimHash of the distinct shingles), bands and size in place of text."""

    def sign(some: list[str | None]) -> dict[str, pa.Array]:
        node, fp, keys = [], np.zeros(len(some), np.uint64), np.zeros((len(some), BANDS), np.uint64)
        for k, text in enumerate(some):
            found = shingle_set(text.encode() if text else b"", shingle)
            node.append(xxhash.xxh3_128_digest(found.tobytes()))
            fp[k], keys[k] = simhash.majority([found]), bands(found)
        flat = pa.array(keys.reshape(-1).view(np.int64))
        return {"node": pa.array(node, pa.binary()), "fp": pa.array(fp.view(np.int64)), "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), flat)}

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")
    return append_columns(texts.select("*", size), {"node": "binary", "fp": "long", "bands": "array<bigint>"}, sign).drop("text")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _by_bits(nodes: DataFrame, most_bits: int) -> DataFrame:
    """Pairs a < b of nodes that the Gray-order index links, or whose fingerprints are equal."""
    lows = materialise(nodes.groupBy("fp").agg(F.min("node").alias("low")), "distinct")
    near = simhash.links(lows.select("fp"), lows.count(), most_bits)
    far_ends = near.join(lows.select(F.col("fp").alias("src"), F.col("low").alias("a")), "src").join(lows.select(F.col("fp").alias("dst"), F.col("low").alias("b")), "dst")
    equal = nodes.select("node", "fp").join(lows, "fp").select(F.col("low").alias("a"), F.col("node").alias("b"))
    return _ordered(far_ends.select("a", "b").union(equal))


def _checked(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """src, dst: the pairs whose whole texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, np.ndarray] = (b"", np.array([], np.uint64))
        for batch in batches:
            keep = []
            ends = batch.column(0).to_pylist()
            for a, x, y in zip(ends, as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
                if a != held[0]:
                    held = a, shingle_set(x, shingle)
                keep.append(similar(held[1], shingle_set(y, shingle), least))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["src", "dst"])

    own = lambda end, text: texts.select(F.col("node").alias(end), F.col("text").alias(text))
    return pairs.join(own("b", "y"), "b").join(own("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(run, "src binary, dst binary")


def _sub_blocks(n: Column, size: Column) -> Column:
    return F.least(n, F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES))).cast("long")


def _settle(crowded: DataFrame, labels: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """src, dst: links inside blocks whose nodes are in several components so far; not every link."""
    placed = materialise(crowded.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    parts = placed.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "label", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("h").alias("h"), F.count("*").alias("labels")).where("labels > 1")
    once = mixed.groupBy("n", "h").agg(F.min(F.struct("key", "most", "size")).alias("b"))  # bands with the same nodes count once
    few = _sub_blocks(F.col("n") - F.col("b.most.n"), F.col("b.size") - F.col("b.most.size"))
    mixed = materialise(once.select("b.key", F.col("b.most.label").alias("most"), few.alias("few"), _sub_blocks(F.col("b.most.n"), F.col("b.most.size")).alias("many")), "mixed")
    home = F.when(F.col("label") == F.col("most"), F.col("few") + F.expr("pmod(xxhash64(node), many)")).otherwise(F.expr("pmod(xxhash64(node), few)"))
    rows = placed.join(mixed, "key").select("key", "node", "fp", "label", "few", "many", home.alias("home"))
    last = F.when(F.col("home") < F.col("few"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1
    rows = rows.select("key", "node", "fp", "label", "home", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("to"))
    rows = rows.select("key", F.least("home", "to").alias("i"), F.greatest("home", "to").alias("j"), "home", "node", "fp", "label")

    def compare(table: pa.Table) -> pa.Table:
        col = table.combine_chunks().to_pydict()
        nodes, labels, home = col["node"], col["label"], np.array(col["home"])
        fps = np.array(col["fp"], np.int64).view(np.uint64)
        names = {c: k for k, c in enumerate(dict.fromkeys(labels))}
        group, root = [names[c] for c in labels], list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        differ = np.bitwise_count(fps[:, None] ^ fps)
        own = np.array(group)
        at = np.arange(len(nodes))
        open_ = (differ <= FAR) & (own[:, None] != own) & (at[:, None] < at)
        if col["i"][0] != col["j"][0]:
            open_ &= home[:, None] != home
        x, y = np.nonzero(open_)
        order = np.argsort(differ[x, y], kind="stable")
        sets: dict[int, np.ndarray] = {}
        src, dst = [], []
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            a, b = find(group[i]), find(group[j])
            if a == b:
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingle_set((col["text"][k] or "").encode(), shingle)
            if similar(sets[i], sets[j], least):
                root[a] = b
                src.append(nodes[i])
                dst.append(nodes[j])
        return pa.table({"src": pa.array(src, pa.binary()), "dst": pa.array(dst, pa.binary())})

    return rows.join(texts, "node").select("key", "i", "j", "home", "node", "fp", "label", "text").groupBy("key", "i", "j").applyInArrow(compare, "src binary, dst binary")


def classes(nodes: DataFrame, keyed: DataFrame, shingle: int, least: float, most_bits: int) -> DataFrame:
    """node and label of nodes that links join to others; nodes is written, keyed has doc_id, _row and text."""
    entries = nodes.select("node", "fp", "size", F.explode("bands").alias("key"))
    blocks = entries.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    crowded = materialise(entries.join(blocks, "key"), "blocks")
    by_band = crowded.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    pairs = materialise(by_band.union(_by_bits(nodes, most_bits)).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = nodes.join(ends, "node").select("node", F.col("_first.doc_id").alias("_id"), F.col("_first._row").alias("_key"))
    found = keyed.join(wanted, (F.col("_row") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    texts = materialise(found.dropDuplicates(["node"]), "texts")
    close = materialise(_checked(pairs, texts, shingle, least), "close")
    more = materialise(_settle(crowded.select("key", "node", "fp", "size"), connected_components(close), texts, shingle, least), "more")
    return connected_components(close.union(more))


def survivors(df: DataFrame, shingle: int = 5, similarity: float = 0.8, most_bits: int = 3) -> DataFrame:
    """df with one row of each component of similar texts: the smallest doc_id, then the smallest row hash."""
    own, restore = shield(df, "_row", "_id", "_key")
    keyed = own.select("*", F.xxhash64(F.lit(0), *hashable(own)).alias("_row"))
    signed = materialise(signatures(keyed.select("doc_id", "text", "_row"), shingle), "signatures")
    first = F.min(F.struct("doc_id", "_row")).alias("_first")
    nodes = materialise(signed.groupBy("node").agg(first, F.min("fp").alias("fp"), F.max("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    found = classes(nodes, keyed.select("doc_id", "_row", "text"), shingle, similarity, most_bits)
    labelled = nodes.select("node", "_first").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    keepers = labelled.groupBy("label").agg(F.min("_first").alias("_first"))
    return restore(simhash.kept_rows(keyed, signed.select("doc_id", "_row"), keepers))
