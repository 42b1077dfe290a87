"""Mixture-controlled packing: deficit round-robin over source queues into fixed-length sequences.

Documents are dealt to buckets of about BUCKET tokens by the hash of a row number, whatever their source.
Within a bucket each source is a queue.  Every window adds to a source's deficit its target share of the
window and serves whole deficits; what the queues that have run out leave goes to the others.  The deficit
that a bucket starts with is what all buckets before it have left, known in closed form from the token totals
by bucket and source, so that no bucket waits for another.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import PATTERN, load
from .common import materialize, small_batches

#: Tokens of a sequence, sequences of a window, tokens of a bucket, buckets of a block.
LENGTH, WINDOW, BUCKET, BLOCK = 1024, 16, 1_000_000, 4_096

_ENCODERS: dict = {}
_LONG_BLANK = re.compile(r"\s{10000}").search


def encoder(path: str):
    """text -> ids (numpy): the tiktoken library over the same vocabulary, as ids in it grow with the merges' ranks."""
    if path not in _ENCODERS:
        bpe = load(path)
        merged = [v & ((1 << 20) - 1) for v in bpe.rank.values()]
        if merged != sorted(merged):
            _ENCODERS[path] = lambda text: np.array(bpe.encode(text), np.uint32)
        else:
            ranks = {t: i for i, t in bpe.bytes_of.items() if i not in bpe.special.values()}
            lib = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=bpe.special)
            # that library's pattern backtracks on each blank of a run, and fails on very long ones
            own = lambda text: np.array(bpe.encode(text), np.uint32)
            _ENCODERS[path] = lambda text: own(text) if _LONG_BLANK(text) else lib.encode_to_numpy(text, allowed_special="all")
    return _ENCODERS[path]


def width(path: str) -> int:
    """Bytes that hold any id of the vocabulary."""
    return 2 if max(load(path).bytes_of) < 1 << 16 else 4


def token_table(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, source, n, ids) with ids as little-endian numbers of width(path) bytes and the end id after each document."""
    small_batches(docs.sparkSession)
    kind = f"<u{width(path)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            ids = [np.append(encode(t) if t else np.zeros(0, np.uint32), end).astype(kind) for t in b.column(2).to_pylist()]
            blobs = pa.array([x.tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in ids], pa.int64()), blobs], names=["doc_id", "source", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, n long, ids binary")


def fill(queues: list[list[tuple[int, int]]], shares: np.ndarray, deficits: np.ndarray, size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of size tokens as pieces (document, start, length).

    queues: by source, documents as (index, tokens).  Every window is full but the last.
    """
    at = [0] * len(queues)
    used = [0] * len(queues)
    left = np.array([sum(n for _, n in q) for q in queues], np.int64)
    deficits = deficits.astype(float).copy()
    while left.any():
        room, pieces = size, []
        deficits += shares * size
        take = np.minimum(left, np.maximum(0, np.floor(deficits))).astype(np.int64)
        if take.sum() > room:  # more is owed than fits: in proportion, the largest first
            take = np.floor(take * (room / take.sum())).astype(np.int64)
        room -= int(take.sum())
        for s in np.lexsort((np.arange(len(queues)), take - deficits)):  # the largest deficit first
            if room <= 0:
                break
            weight = shares[left > take].sum()
            more = min(room, int(left[s] - take[s]), max(1, int(np.ceil(room * shares[s] / weight))) if weight > 0 else room)
            take[s] += more
            room -= more
        for s in np.argsort(take - left, kind="stable"):  # what still fits, from the longest queues
            more = min(room, int(left[s] - take[s]))
            take[s] += more
            room -= more
        deficits -= take
        left -= take
        for s in np.flatnonzero(take):
            n = int(take[s])
            while n:
                doc, length = queues[s][at[s]]
                part = min(n, length - used[s])
                pieces.append((doc, used[s], part))
                n -= part
                used[s] += part
                if used[s] == length:
                    at[s], used[s] = at[s] + 1, 0
        yield pieces


def cut(pieces: Iterator[tuple[int, int, int]], total: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset): pieces cut at the ends of sequences.

    All sequences are full but those of the rest, whose lengths are powers of two and so need no padding.
    """
    rest = total % length
    ends = [length] * (total // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    sequence = offset = 0
    for doc, start, n in pieces:
        while n:
            part = min(n, ends[sequence] - offset)
            yield doc, start, part, sequence, offset
            start, n, offset = start + part, n - part, offset + part
            if offset == ends[sequence]:
                sequence, offset = sequence + 1, 0


def _before(sums: DataFrame, name: str) -> DataFrame:
    """(bucket, source, name): the sum of n over a source's earlier buckets; by blocks of buckets, so that no task sorts them all."""
    blocks = sums.withColumn("block", F.floor(F.col("bucket") / BLOCK))
    earlier = (W.unboundedPreceding, -1)
    within = blocks.withColumn("near", F.sum("n").over(W.partitionBy("block", "source").orderBy("bucket").rowsBetween(*earlier)))
    totals = blocks.groupBy("block", "source").agg(F.sum("n").alias("n"))
    far = totals.select("block", "source", F.sum("n").over(W.partitionBy("source").orderBy("block").rowsBetween(*earlier)).alias("far"))
    zero = F.lit(0).cast("long")
    return within.join(far, ["block", "source"]).select("bucket", "source", (F.coalesce("near", zero) + F.coalesce("far", zero)).alias(name))


def pack(docs: DataFrame, path: str, end: int = 0, length: int = LENGTH, window: int = WINDOW, mixture: dict[str, float] | None = None, bucket_tokens: int = BUCKET) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    mixture: target weights by source; without it, or for sources that it lacks, the sources' shares of all
    tokens, so that no queue runs out early.  A null source is the source of that name ''; a null text is
    empty and gives the end id alone; repeated rows are packed each.  An empty table gives no row.
    """
    tokens = materialize(token_table(docs, path, end).withColumn("row", F.monotonically_increasing_id()), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_tokens))
    tokens = tokens.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(n_buckets)))
    sums = materialize(tokens.groupBy("bucket", "source").agg(F.sum("n").alias("n")), "packing-sums")
    sources = sums.groupBy("source").agg((F.sum("n") / F.lit(float(max(1, total)))).alias("share"))
    if mixture:
        wanted = docs.sparkSession.createDataFrame([(json.dumps(mixture),)], "m string").select(F.explode(F.from_json("m", "map<string,double>")).alias("source", "wanted"))
        sources = sources.join(F.broadcast(wanted), "source", "left").select("source", F.coalesce("wanted", "share").alias("share"))
        weight = sources.agg(F.sum("share")).first()[0] or 1.0
        sources = sources.withColumn("share", F.col("share") / F.lit(weight))
    # a source that has nothing in a bucket changes none of its windows, so only pairs that occur are held
    whole = _before(sums.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("source", F.lit("")), "all")
    own = _before(sums, "own").join(whole.drop("source"), "bucket").join(sources, "source")
    state = own.select("bucket", "source", "share", (F.col("share") * F.col("all") - F.col("own")).alias("deficit"))
    step, kind = length * window, f"<u{width(path)}"

    def run(key: tuple, rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        states = states.sort_values("source", ignore_index=True)
        place = {s: i for i, s in enumerate(states["source"])}
        queues: list[list[tuple[int, int]]] = [[] for _ in place]
        for i, (s, n) in enumerate(zip(rows["source"], rows["n"], strict=True)):
            queues[place[s]].append((i, int(n)))
        filled = fill(queues, states["share"].to_numpy(float), states["deficit"].to_numpy(float), step)
        out = list(cut((p for w in filled for p in w), int(rows["n"].sum()), length))
        doc, start, n, sequence, offset = np.array(out, np.int64).reshape(-1, 5).T
        blobs = [memoryview(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in rows["ids"]]
        crc = [zlib.crc32(blobs[d][4 * a : 4 * (a + k)]) for d, a, k in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)]
        picked = rows.iloc[doc]
        return pd.DataFrame({"doc_id": picked["doc_id"].to_numpy(), "source": picked["source"].to_numpy(), "start": start, "length": n, "ids_crc32": crc, "doc_tokens": picked["n"].to_numpy(), "sequence_id": (int(key[0]) << 32) + sequence, "offset": offset})

    schema = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInPandas(run, schema)
