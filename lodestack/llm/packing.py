"""Shortest-pack-first packing over the histogram of lengths.

Documents become token ids (with an end id) in one pass; pieces are at most ``capacity`` long.
The histogram of piece lengths has ``capacity`` rows at most, whatever the corpus holds, so it
goes to the driver. There every length, longest first, is placed on the shortest open packs; a
run of equal packs is one entry with a count, so a step places a whole run. Each placement is an
interval: the r-th piece of this length goes to sequence s + r at this offset. Pieces then get
their rank within their length by two narrow shuffles and are joined to the intervals.

Edge cases: a null or empty text is the end id alone; repeated rows are packed as often as they
come; ids may be null; other columns are ignored; an empty table gives an empty result. Very long
texts are cut into full sequences and a rest.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestack.llm.shared import materialise, partitions

CAPACITY = 4096
#: Intervals up to this number are broadcast (about 40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Equal pieces that share a rank window up to this number; more are dealt to several.
CROWD = 2_000_000
#: In a text of these characters alone, canonical composition changes nothing and white space is plain.
UNUSUAL = re.compile("[^\\x00-\\x1b\\x20-\\u02ff\\u2010-\\u2027\\u20ac]")
#: Longer texts are taken in parts that start at a space, which no token spans.
WINDOW = 1 << 20
GAP = re.compile(r"(?<=\S) (?=\S)")
#: Texts are encoded together up to so many characters.
GROUP = 2 << 20
#: Parts whose tokens are Python objects at one time.
MERGED = 4096
#: Beyond this number of words a worker begins anew and forgets those that it has not met since it last did.
CACHE_WORDS = 100_000
#: The split of this kind of vocabulary, for text without white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Characters of usual texts, lowered, that are neither letters nor numbers nor white space; at the end of a run they are one part of SPLIT.
MARKS = "".join(sorted({low for c in map(chr, [*range(0x2028), 0x20AC]) if not UNUSUAL.match(c) for low in c.lower() if unicodedata.category(low)[0] not in "LN" and not low.isspace()}))

#: What a tokenizer file must say for its texts to be split here; any other file is left to the library as a whole.
KIND = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


def of_kind(tokenizer, kind: dict) -> bool:
    """Whether a tokenizer's own description says what kind says, its model is plain merges, and its added tokens are special, unnormalised and start with <|."""
    own = json.loads(tokenizer.to_str())
    model, added = own["model"], own["added_tokens"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    return plain and all(own.get(k) == v for k, v in kind.items()) and all(t["special"] and t["content"].startswith("<|") and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and never merges across it; any other kind goes through the library.

    Texts are lowered and taken together: Arrow numbers the distinct runs between white space and
    trims the marks at their ends, which are a part of their own. So Python meets a word once in a
    group, whatever its case and the marks behind it, and keeps its packed little-endian 32-bit ids
    for later groups. New words are split as the tokenizer does it, and their parts go to the
    tokenizer's own merges, without the library's bookkeeping of offsets. Runs that may hold special
    strings and texts with unusual characters go through the library as a whole.
    """

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.plain = of_kind(self.tok, KIND)
        self.merge = self.tok.model.tokenize
        self.find = regex.compile(SPLIT).findall
        odd = sorted({*range(256)} - {*range(33, 127), *range(161, 173), *range(174, 256)})
        self.bytes = np.arange(256, dtype="<u4")
        self.bytes[odd] = np.arange(256, 256 + len(odd))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text."""
        if not self.plain:
            return [self._library(text) for text in texts]
        found: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[list[bytes], int, str]] = []
        size = 0

        def settle() -> None:
            for (parts, at, _), raw in zip(group, self._group([some for _, _, some in group]), strict=True):
                parts[at] = raw
            group.clear()

        for parts, text in zip(found, texts, strict=True):
            for by_library, some in self._windows(text):
                parts.append(self._library(some) if by_library else b"")
                if not by_library:
                    group.append((parts, len(parts) - 1, some.lower()))
                    size += len(some) + 64
                    if size >= GROUP:
                        settle()
                        size = 0
        settle()
        return [parts[0] if len(parts) == 1 else b"".join(parts) for parts in found]

    @staticmethod
    def _windows(text: str) -> Iterator[tuple[bool, str]]:
        """A text in windows, and whether the library must encode them."""
        at = 0
        while at < len(text):
            gap = GAP.search(text, at + WINDOW) if len(text) - at > WINDOW else None
            end = gap.start() if gap else len(text)
            some = text[at:end]
            at = end
            if UNUSUAL.search(some):
                yield True, some
            elif "<|" in some:
                for special, runs in itertools.groupby(some.split(), lambda run: "<|" in run):
                    yield special, " ".join(runs)
            else:
                yield False, some

    def _group(self, texts: list[str]) -> list[bytes]:
        """Packed ids of lowered texts of usual characters without special strings."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        if not len(words.values):
            return [b""] * len(texts)
        places, numbers = words.offsets.to_numpy(), words.values.dictionary_encode()
        del words
        runs = numbers.dictionary
        trimmed = pc.utf8_rtrim(runs, MARKS)
        cores = trimmed.dictionary_encode()
        ids = pa.array(self._look_up(cores.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(cores.indices)
        n_marks = pc.binary_length(runs).to_numpy() - pc.binary_length(trimmed).to_numpy()
        at = np.flatnonzero(n_marks)
        if len(at):
            ends = np.frombuffer(runs.buffers()[1], np.int64)[at + 1]
            raw = runs.buffers()[2].to_pybytes()
            marks = [raw[a:b] for a, b in zip((ends - n_marks[at]).tolist(), ends.tolist(), strict=True)]
            distinct = list(dict.fromkeys(marks))
            by_marks = dict(zip(distinct, self._look_up([m.decode() for m in distinct]), strict=True))
            last = [b""] * len(runs)
            for k, m in zip(at.tolist(), marks, strict=True):
                last[k] = by_marks[m]
            ids = pc.binary_join_element_wise(ids, pa.array(last, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        _, offsets, data = ids.take(numbers.indices).buffers()
        cuts = np.frombuffer(offsets, np.int64)[places].tolist()
        whole = memoryview(data or b"")
        return [bytes(whole[a:b]) for a, b in itertools.pairwise(cuts)]

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct lowered words."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [w for w in words if w not in known]
        if older:
            back = [w for w in new if w in older]
            known.update(zip(back, map(older.__getitem__, back), strict=True))
            new = [w for w in new if w not in known]
        split = {w: self.find(w) for w in new if not w.isalpha()}
        parts = [w for w in new if w.isalpha()]
        parts = list(dict.fromkeys(itertools.chain(parts, (p for found in split.values() for p in found if p not in known))))
        for some in itertools.batched(parts, MERGED):
            known.update(zip(some, self._merged(some), strict=True))
        for w, found in split.items():
            known[w] = b"".join([known[p] for p in found])
        return list(map(known.__getitem__, words))

    def _merged(self, parts: tuple[str, ...]) -> list[bytes]:
        """Packed ids of parts, which hold no white space, by the tokenizer's merges."""
        mapped = self.bytes[np.frombuffer("\n".join(parts).encode(), np.uint8)].tobytes().decode("utf-32-le")
        tokens = [self.merge(part) for part in mapped.split(chr(self.bytes[10]))]
        raw = np.array([t.id for some in tokens for t in some], "<u4").tobytes()
        cuts = itertools.accumulate([4 * len(some) for some in tokens], initial=0)
        return [raw[a:b] for a, b in itertools.pairwise(cuts)]


def pieces(df: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, with keep_ids also ids (packed)."""
    end = np.array([end_id], "<u4").tobytes()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def made(encoder: WordEncoder, ids: list, texts: list[str]) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for doc_id, raw in zip(ids, encoder.encode_all(texts), strict=True):
            raw += end
            total = len(raw) // 4
            for start in range(0, total, capacity):
                part = raw[4 * start : 4 * (start + capacity)]
                for values, x in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), total, part if keep_ids else None), strict=True):
                    values.append(x)
        arrays = {c: pa.array(v, pa.int64()) for c, v in zip(columns, out, strict=False)}
        return pa.RecordBatch.from_pydict(arrays | ({"ids": pa.array(out[5], pa.binary())} if keep_ids else {}))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer_path)
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                size += len(texts[-1]) + 64
                if size >= GROUP:
                    yield made(encoder, ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield made(encoder, ids, texts)
        pa.default_memory_pool().release_unused()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def place(histogram: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, count, first sequence, offset) that place every piece.

    An entry of the heap is a run of packs with the same pattern: what they hold, the first
    sequence, how many. The shortest packs take the next length; if not even they have room, as
    many packs are opened as the length needs by itself.
    """
    runs: list[tuple[int, int, int]] = []
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length, count in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit into {capacity}")
        rank = 0
        while rank < count:
            if not runs or runs[0][0] + length > capacity:
                fresh = -(-(count - rank) // (capacity // length))
                heapq.heappush(runs, (0, opened, fresh))
                opened += fresh
            used, first, packs = heapq.heappop(runs)
            taken = min(packs, count - rank)
            out.append((length, rank, taken, first, used))
            if used + length < capacity:
                heapq.heappush(runs, (used + length, first, taken))
            if taken < packs:
                heapq.heappush(runs, (used, first + taken, packs - taken))
            rank += taken
    return out


INTERVALS = T.StructType([T.StructField(c, T.LongType(), False) for c in ("p_length", "p_rank", "p_count", "p_sequence", "p_offset")])


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces. The input is read three times, so it should be a written table."""
    spark = cut.sparkSession
    fan = 4 * partitions(spark)
    histogram = [(r["length"], r["count"]) for r in cut.groupBy("length").count().collect()]  # capacity rows at most
    placed = place(histogram, capacity)
    intervals = spark.createDataFrame(placed, INTERVALS) if placed else spark.createDataFrame([], INTERVALS)
    if len(placed) <= BROADCAST_ROWS:
        intervals = F.broadcast(intervals)
    spread = cut.withColumn("_sub", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(fan))).withColumn("_part", F.lit(0))
    crowded = materialise(spread.groupBy("length", "_sub").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD), "crowded")
    if not crowded.isEmpty():  # rows / CROWD of them at most; which of equal pieces comes first is all the same
        placed_once = materialise(spread.withColumn("_place", F.monotonically_increasing_id()), "pieces")
        parts = F.coalesce(F.pmod(F.xxhash64("_place"), F.ceil(F.col("_n") / CROWD)), F.lit(0)).cast("int")
        spread = placed_once.join(F.broadcast(crowded), ["length", "_sub"], "left").withColumn("_part", parts).select(*spread.columns)
    below = Window.partitionBy("length").orderBy("_sub", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("length", "_sub", "_part").agg(F.count("*").alias("_n")).select("length", "_sub", "_part", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_sub", "_part").orderBy("doc_id", "start", "ids_crc32")
    ranked = spread.withColumn("_row", F.row_number().over(within)).join(starts, ["length", "_sub", "_part"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    fits = (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_rank")) & (F.col("_rank") < F.col("p_rank") + F.col("p_count"))
    return ranked.join(intervals, fits).select(
        *cut.columns, (F.col("p_sequence") + F.col("_rank") - F.col("p_rank")).alias("sequence_id"), F.col("p_offset").alias("offset")
    )


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack documents; with keep_ids the pieces carry their ids."""
    return pack(materialise(pieces(df, tokenizer_path, end_id, capacity, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame, pad_id: int = 0, capacity: int = CAPACITY, powers: bool = True) -> DataFrame:
    """The sequences of pack_documents(keep_ids=True): sequence_id, n_tokens, ids (packed), padded to capacity.

    With powers, a sequence whose tokens number a power of two stays at that length, as batches of
    such lengths need no padding.
    """
    n = F.col("n_tokens")
    exact = (F.bit_count(n) == 1) if powers else F.lit(False)
    pad = F.when(exact, F.lit("").cast("binary")).otherwise(F.expr(f"unhex(repeat('{pad_id.to_bytes(4, 'little').hex()}', cast({capacity} - n_tokens as int)))"))
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
        .withColumn("ids", F.expr("aggregate(_parts, cast('' as binary), (a, x) -> concat(a, x.ids))"))
        .select("sequence_id", "n_tokens", F.concat("ids", pad).alias("ids"))
    )
