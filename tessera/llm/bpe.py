"""Byte-level BPE: encoding by a contiguous array of adjacent ranks, decoding, and document digests."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The published pattern that splits text before the merges of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a word up to which its ranks are scanned, beyond which a heap finds the least.
SHORT = 128
#: Chunks in a worker's cache and characters of a chunk that is cached.
CACHED, LONGEST = 500_000, 64
BITS = 20
MASK, NONE = (1 << BITS) - 1, 1 << 60

_LOADED: dict = {}


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe(dict):
    """Ids by chunk, as tuples; a miss is merged and kept until the cache is full, then a new cache starts."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.single = [vocab[bytes([b])] for b in range(256)]
        #: Rank and merged id of a pair of ids, each two numbers packed in one.
        self.rank: dict[int, int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, m.split(" ") if isinstance(m, str) else m)
            self.rank[vocab[a] << BITS | vocab[b]] = r << BITS | vocab[a + b]
        self.words = regex.compile(PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def __missing__(self, chunk: str) -> tuple[int, ...] | None:
        """Ids of a space and a chunk without spaces; None if white space stands at an end, where words may reach further."""
        ids = None
        if chunk and not chunk[0].isspace() and not chunk[-1].isspace():
            ids = tuple(self._merged(" " + chunk))
        if len(chunk) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = ids
        return ids

    def _merged(self, text: str) -> Iterator[int]:
        """Ids of a text without special tokens, word by word."""
        for word in self.words(text):
            ids = [self.single[b] for b in word.encode()]
            yield from self._scan(ids) if len(ids) <= SHORT else self._heap(ids)

    def _ordinary(self, text: str) -> list[int]:
        """Ids of a text without special tokens.  A single space between two other characters starts a word."""
        head, *chunks = text.split(" ")
        found = list(map(self.__getitem__, chunks))
        if None in found or not head or head[-1].isspace():
            return list(self._merged(text))
        return list(chain(self._merged(head), chain.from_iterable(found)))

    def _scan(self, parts: list[int]) -> list[int]:
        """Repeatedly merge at the leftmost least rank; only the two neighbouring ranks are refreshed."""
        get = self.rank.get
        ranks = [get(a << BITS | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = new = least & MASK
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << BITS | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << BITS | new, NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        """The same for a long word, in n log n steps: a heap of ranks over a linked list of parts."""
        n, rank = len(parts), self.rank
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank[p], i, p) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (p := a << BITS | b) in rank]
        heapq.heapify(heap)
        while heap:
            r, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or parts[i] << BITS | parts[j] != pair:
                continue
            parts[i], parts[j] = r & MASK, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m >= 0 and (p := parts[k] << BITS | parts[m]) in rank:
                    heapq.heappush(heap, (rank[p], k, p))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of special tokens in it become those tokens."""
        if not any(s in text for s in self.special):
            return self._ordinary(text)
        parts = self.split_special(text)
        return list(chain.from_iterable([self.special[p]] if i % 2 else self._ordinary(p) for i, p in enumerate(parts)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def load(path: str) -> ByteBpe:
    """The worker's encoder of this vocabulary; kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row; a null text counts as empty.  Repeated rows are encoded each."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = [bpe.encode(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row, without passing ids and texts back to the JVM."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        decimal = {i: str(i) for i in bpe.bytes_of}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            n, of_ids, of_text = [], [], []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text) if text else []
                n.append(len(ids))
                of_ids.append(sha(",".join(map(decimal.__getitem__, ids))))
                of_text.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
