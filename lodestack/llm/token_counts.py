"""Exact token counts without token ids: each distinct pre-token is encoded once.

A pre-token is what the tokenizer's own split leaves to its merges. Map tasks split whole texts
and keep, for a block of documents, the block's distinct pre-tokens with the documents and
frequencies of each. Blocks are cut by a hash of the pre-token into buckets and exchanged as
packed rows; the task that gets a bucket encodes every distinct pre-token of it once, joins the
piece counts to the frequencies and sums by document. A second small exchange adds a document's
sums up. Pre-tokens that are themselves one piece of the vocabulary (a fixed table of some 50,000
entries) are counted where they stand and are not exchanged.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and ids give a row
each; ids may be null; other columns are ignored; an empty table gives an empty result. Documents
are known by their place in a block, so an input whose rows might come in another order when a
task runs again, as behind a shuffle, is written first. A tokenizer file of another kind than this
split is refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.packing import of_kind
from lodestack.llm.shared import partitions, stable

#: The split of byte-level BPE vocabularies of this kind. White space beyond these is UNUSUAL.
_WS = r"\t-\r \x85\xa0"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: What a tokenizer file must say for this split to be its own.
KIND = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "truncation": None, "padding": None}
#: A text with other characters goes through the library's own split, whose Unicode tables may differ.
UNUSUAL = re.compile("[^\\x00-\\x1b\\x20-\\u02ff\\u2010-\\u2027\\u20ac]")
GAP = re.compile(r"(?<=\S) (?=\S)")
#: A block of documents closes at so many bytes of text.
BLOCK_BYTES = 16 << 20


def windows(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A long text in pieces that start at a single space between two other characters, where a pre-token always starts."""
    at = 0
    while len(text) - at > size:
        gap = GAP.search(text, at + size)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


class PieceCounter:
    """Piece counts of pre-tokens, by the library; built once in a worker."""

    _made: dict[str, PieceCounter] = {}

    def __init__(self, path: str):
        self.tok = self.check(path)
        self.find = regex.compile(SPLIT).findall
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.special]
        self.cut = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        vocab = self._vocabulary()
        self.single = {v for v, n in zip(vocab, self.pieces(vocab), strict=True) if n == 1}

    @staticmethod
    def check(path: str):
        """The tokenizer of a file, if it is of this kind."""
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        if not of_kind(tok, KIND):
            raise ValueError(f"{path} does not split texts as this operator does")
        return tok

    @classmethod
    def of(cls, path: str) -> PieceCounter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _vocabulary(self) -> list[str]:
        """Vocabulary entries that are whole pre-tokens of plain characters."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain}
        back |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        found = []
        for entry in self.tok.get_vocab(with_added_tokens=False):
            try:
                text = bytes(back[c] for c in entry).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if not UNUSUAL.search(text) and self.find(text) == [text]:
                found.append(text)
        return found

    def split(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in lists of bounded size; special tokens are cut out."""
        for part in self.cut.split(text) if self.cut and "<|" in text else [text]:
            for some in windows(part):
                if UNUSUAL.search(some):
                    yield [some[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(some)]
                else:
                    yield self.find(some)

    def specials_in(self, text: str) -> int:
        return len(self.cut.findall(text)) if self.cut and "<|" in text else 0

    def pieces(self, pretokens: list[str]) -> list[int]:
        """Pieces of each; special strings cannot occur, as split() has cut them out."""
        return [len(e.ids) for e in self.tok.encode_batch(pretokens, add_special_tokens=False)] if pretokens else []


def _pack(words: list[str], of: np.ndarray, doc: np.ndarray, n: np.ndarray) -> bytes:
    """A bucket of a block: its words, and for each entry the word, the document and the frequency."""
    text = [w.encode() for w in words]
    head = np.array([len(words), len(of)], np.int64).tobytes() + np.array([len(w) for w in text], np.int32).tobytes()
    return zstandard.compress(head + of.astype(np.int32).tobytes() + doc.astype(np.int32).tobytes() + n.astype(np.int32).tobytes() + b"".join(text), 1)


def _unpack(raw: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(raw)
    words, entries = np.frombuffer(raw, np.int64, 2)
    at = 16
    parts = []
    for count in (words, entries, entries, entries):
        parts.append(np.frombuffer(raw, np.int32, count, at))
        at += 4 * int(count)
    ends = np.cumsum(parts[0]) + at
    return [raw[e - k : e].decode() for e, k in zip(ends.tolist(), parts[0].tolist(), strict=True)], parts[1], parts[2], parts[3]


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"key": pa.int32(), "block": pa.int64(), "info": pa.binary(), "payload": pa.binary()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], kinds[c]) for k, c in enumerate(names.split())})


class _Block:
    def __init__(self):
        self.ids, self.n_bytes, self.known = [], [], []
        self.index: dict[str, int] = {}
        self.seen: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, text: str | None, counter: PieceCounter) -> None:
        text = text or ""
        single, index, known = counter.single, self.index, counter.specials_in(text)
        for pretokens in counter.split(text):
            rest = [index.setdefault(t, len(index)) for t in pretokens if t not in single]
            self.seen.append(np.array(rest, np.int64) + (len(self.ids) << 32))
            known += len(pretokens) - len(rest)
        size = len(text) if text.isascii() else len(text.encode())
        self.ids.append(doc_id)
        self.n_bytes.append(size)
        self.known.append(known)
        self.size += size + 64

    def rows(self, block: int, buckets: int) -> Iterator[tuple]:
        ids = pa.RecordBatch.from_pydict({"id": pa.array(self.ids, pa.int64()), "n_bytes": pa.array(self.n_bytes, pa.int64()), "known": pa.array(self.known, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ids.schema) as out:
            out.write_batch(ids)
        yield block % buckets, block, sink.getvalue().to_pybytes(), None
        pairs, n = np.unique(np.concatenate(self.seen), return_counts=True)
        of, doc = (pairs & 0xFFFFFFFF), (pairs >> 32)
        words = list(self.index)
        bucket = np.array([zlib.crc32(w.encode()) % buckets for w in words], np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)  # of a word in its bucket
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        place[order] = np.arange(len(words)) - starts[bucket[order]]
        by = np.argsort(bucket[of], kind="stable") if len(words) else np.array([], np.int64)
        of, doc, n = of[by], doc[by], n[by]
        cuts = np.searchsorted(bucket[of], np.arange(buckets + 1)) if len(words) else np.zeros(buckets + 1, int)
        for b in range(buckets):
            if starts[b] < starts[b + 1]:
                own = slice(cuts[b], cuts[b + 1])
                yield b, block, None, _pack([words[i] for i in order[starts[b] : starts[b + 1]]], place[of[own]], doc[own], n[own])


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id (long), n_bytes and n_tokens."""
    spark = df.sparkSession
    buckets = partitions(spark)
    PieceCounter.check(tokenizer_path)
    df = stable(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), "texts")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, block, made = PieceCounter.of(tokenizer_path), _Block(), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(doc_id, text.as_py(), counter)
                if block.size >= BLOCK_BYTES:
                    yield _batch(list(block.rows((part << 24) + made, buckets)), "key block info payload")
                    block, made = _Block(), made + 1
        if block.ids:
            yield _batch(list(block.rows((part << 24) + made, buckets)), "key block info payload")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.of(tokenizer_path)
        pieces: dict[str, int] = {}
        for batch in batches:
            out = []
            for block, info, payload in zip(batch.column("block").to_pylist(), batch.column("info"), batch.column("payload"), strict=True):
                if info.is_valid:
                    out.append((block, info.as_py(), None))
                    continue
                words, of, doc, n = _unpack(payload.as_py())
                new = [w for w in words if w not in pieces]
                pieces.update(zip(new, counter.pieces(new), strict=True))
                each = np.fromiter(map(pieces.__getitem__, words), np.int64, len(words))
                total = np.bincount(doc, weights=each[of] * n).astype(np.int64)
                at = np.flatnonzero(total)
                out.append((block, None, zstandard.compress(np.stack([at, total[at]]).astype(np.int32).tobytes(), 1)))
            yield _batch(out, "block info payload")

    def finish(group: pa.Table) -> pa.Table:
        info = next(x for x in group.column("info").to_pylist() if x is not None)
        docs = pa.ipc.open_stream(info).read_all()
        tokens = docs.column("known").to_numpy().copy()
        for raw in group.column("payload").to_pylist():
            if raw is not None:
                at, n = np.frombuffer(zstandard.decompress(raw), np.int32).reshape(2, -1)
                tokens[at] += n
        return pa.table({id_col: docs.column("id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(tokens, pa.int64())})

    return (
        df.mapInArrow(split, "key int, block long, info binary, payload binary")
        .repartitionById(buckets, "key")
        .mapInArrow(encode, "block long, info binary, payload binary")
        .groupBy("block")
        .applyInArrow(finish, f"`{id_col}` long, n_bytes long, n_tokens long")
    )


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """count_tokens() with a flag for documents of more than limit tokens."""
    return count_tokens(df, tokenizer_path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
