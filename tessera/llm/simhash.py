"""SimHash fingerprints and exact links within a Hamming radius by vantage-point trees.

Two fingerprints of 64 bits that differ in at most 3 bits differ in at most 1 bit in their upper or in
their lower half.  So each half has a vantage-point tree: its inner nodes split the halves by Hamming
distance to a vantage point, its leaves are the shards.  A fingerprint is stored in its own leaf and
queried in every leaf that its ball of radius 1 reaches by the triangle inequality.  The pairs found are
checked on all 64 bits.  The tree is fitted to a bounded sample, so its broadcast size is bounded; within a
shard the same recursion goes on over the shard's own rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, unused
from .components import connected_components

SEED = 42
#: Shingles that are hashed at a time.
BLOCK = 1 << 16
#: Fingerprints from which a tree is fitted, those wanted in a leaf, leaves of a tree at most.
SAMPLE, LEAF, MAX_LEAVES = 16_384, 2_048, 1_024
#: Rows of a shard that are compared at a time, each with each.
BRUTE = 512
#: Samples of the words of a text, words of a sample.
SAMPLES, SAMPLED = 6, 6
#: Rows and shingles of candidates that one task compares; larger clusters are compared by pairs of blocks.
CLUSTER_ROWS, CLUSTER_SHINGLES = 4_096, 2_000_000


def fingerprint(text: bytes | None, size: int) -> int:
    """SimHash of the shingles of size words; 0 without words.  Memory is bounded by blocks of shingles."""
    words = text.lower().split() if text else []  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones, total = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, total, BLOCK):
        part = words[at : at + BLOCK + size - 1]
        n = len(part) - size + 1
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(part[i : i + size]), SEED) for i in range(n)), np.uint64, n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long.  A null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            fps = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _distance(a: np.ndarray, b: np.ndarray | np.integer) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def fit_tree(keys: np.ndarray, leaf: int, leaves: int, rng: np.random.Generator) -> list | None:
    """[vantage point, threshold, inside, outside] or None for a leaf; splits at the median distance."""
    if leaves < 2 or len(keys) <= leaf:
        return None
    point = keys[rng.integers(len(keys))]
    d = _distance(keys, point)
    for t in sorted({int(np.median(d)), int(np.median(d)) - 1}, key=lambda t: abs(2 * np.count_nonzero(d <= t) - len(d))):
        inside = d <= t
        if 0 < np.count_nonzero(inside) < len(d):
            return [point, t, fit_tree(keys[inside], leaf, leaves // 2, rng), fit_tree(keys[~inside], leaf, leaves // 2, rng)]
    return None


def visits(node: list | None, keys: np.ndarray, radius: int, rows: np.ndarray, home: np.ndarray, path: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows, which of them are at home) for each leaf that the balls around keys[rows] reach."""
    if node is None:
        yield path, rows, home
        return
    point, t, inside, outside = node
    d = _distance(keys[rows], point).astype(np.int64)
    reach = d - radius <= t
    if reach.any():
        yield from visits(inside, keys, radius, rows[reach], (home & (d <= t))[reach], 2 * path)
    reach = d + radius > t
    if reach.any():
        yield from visits(outside, keys, radius, rows[reach], (home & (d > t))[reach], 2 * path + 1)


class _Sets:
    """Union-find over positions, the least position being the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _link(sets: _Sets, fps: np.ndarray, keys: np.ndarray, stored: np.ndarray, asked: np.ndarray, radius: int, most: int, rng: np.random.Generator) -> None:
    """Join all pairs of asked and stored rows within most bits; recursion by vantage points beyond BRUTE rows."""
    if len(stored) > BRUTE:
        point = keys[stored[rng.integers(len(stored))]]
        d, e = _distance(keys[stored], point).astype(np.int64), _distance(keys[asked], point).astype(np.int64)
        t = int(np.median(d))
        t -= np.count_nonzero(d <= t) == len(d)
        if np.count_nonzero(d <= t) and not (e - radius <= t).all() or not (e + radius > t).all():
            _link(sets, fps, keys, stored[d <= t], asked[e - radius <= t], radius, most, rng)
            _link(sets, fps, keys, stored[d > t], asked[e + radius > t], radius, most, rng)
            return
    for at in range(0, len(asked), BRUTE):
        q = asked[at : at + BRUTE]
        for to in range(0, len(stored), 8 * BRUTE):
            s = stored[to : to + 8 * BRUTE]
            for i, j in zip(*np.nonzero(_distance(fps[q][:, None], fps[s][None, :]) <= most), strict=True):
                sets.join(int(q[i]), int(s[j]))


def hamming_links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(a, b): links among the distinct fingerprints of column fp whose closure is that of all pairs within most bits.

    Each shard gives a spanning forest of its pairs, so that a dense group costs no pairs beyond its size.
    """
    distinct = materialize(fps.select("fp").where("fp IS NOT NULL").distinct(), "fingerprints")
    count = distinct.count()
    radius = most // 2
    share = min(1.0, SAMPLE / max(1, count))
    sampled = distinct.where((F.xxhash64("fp").bitwiseAND(0xFFFFFFFF) < int(share * (1 << 32)))).limit(2 * SAMPLE)
    sample = np.sort(np.array([r[0] for r in sampled.collect()], np.int64)).view(np.uint64)
    halves = [(sample >> np.uint64(32 * h)) & np.uint64(0xFFFFFFFF) for h in (0, 1)]
    leaf = max(8, int(LEAF * len(sample) / max(1, count)))
    trees = [fit_tree(np.unique(x), leaf, MAX_LEAVES, np.random.default_rng(h)) for h, x in enumerate(halves)]
    sent = distinct.sparkSession.sparkContext.broadcast(trees)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for h, tree in enumerate(sent.value):
                keys = (fp.view(np.uint64) >> np.uint64(32 * h)) & np.uint64(0xFFFFFFFF)
                for path, rows, home in visits(tree, keys, radius, np.arange(len(fp)), np.ones(len(fp), bool)):
                    shard = np.full(len(rows), 2 * path + h, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[rows]), pa.array(home)], names=["shard", "fp", "home"])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        h = int(rows["shard"].iloc[0]) & 1
        rows = rows.sort_values("fp")
        signed = rows["fp"].to_numpy()
        fp = signed.view(np.uint64)
        keys = (fp >> np.uint64(32 * h)) & np.uint64(0xFFFFFFFF)
        sets = _Sets(len(fp))
        _link(sets, fp, keys, np.flatnonzero(rows["home"].to_numpy()), np.arange(len(fp)), radius, most, np.random.default_rng(0))
        roots = np.array([sets.root(i) for i in range(len(fp))], np.int64)
        linked = roots != np.arange(len(fp))
        return pd.DataFrame({"a": signed[linked], "b": signed[roots[linked]]})

    routed = distinct.mapInArrow(route, "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInPandas(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Fingerprints link at most or fewer differing bits; component_id is the smallest doc_id reachable.
    Null and empty texts have fingerprint zero and are linked like any other.  Rows with the same doc_id
    are kept each; a null doc_id keeps its row and is no component_id unless the component has no other.
    """
    rows = materialize(fingerprints(docs, size), "simhash")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    parts = connected_components(hamming_links(rows, most)).withColumnRenamed("node", "fp")
    named = least.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = materialize(named, "simhash-classes")
    ids = names.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = names.join(ids, "component").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def profile(text: bytes | None, size: int) -> tuple[int, list[int], int]:
    """SimHash of the shingles; SimHashes of small samples of the words; the number of shingles.

    Each sample holds the SAMPLED words that are least under another mixing of their hashes: near copies
    have most samples in common, however long they are.
    """
    words = text.lower().split() if text else []
    own = np.fromiter(map(xxhash.xxh64_intdigest, set(words)), np.uint64)
    samples = []
    for k in range(SAMPLES):
        mixed = (own ^ (own >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        mixed ^= mixed >> np.uint64(32)
        few = np.sort(np.partition(mixed, SAMPLED)[:SAMPLED]) if len(mixed) > SAMPLED else np.sort(mixed)
        bits = np.unpackbits(few.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
        samples.append(int(np.packbits(2 * bits > len(few), bitorder="little").view(np.int64)[0]))
    full = int(np.uint64(fingerprint(text, size)).view(np.int64))
    return full, samples, max(1, len(words) - size + 1)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """All distinct shingle hashes of a text (64 bits)."""
    words = text.lower().split() if text else []
    n = max(1, len(words) - size + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(n)), np.uint64, n))


def closure(sets: list[np.ndarray], least_similarity: float) -> np.ndarray:
    """The root of each set under the closure of all pairs of at least that cosine similarity; exact.

    Breadth first: a set that has been reached is compared at once with all that have not, by a table of its members.
    Sets that have been reached are taken out when they are half of those held.
    """
    size = np.array([len(s) for s in sets])
    members = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    root, waiting = np.arange(len(sets)), np.ones(len(sets), bool)
    table = np.zeros(int(members.max()) + 1 if len(members) else 0, bool)
    held, flat, starts = np.arange(len(sets)), members, at[:-1]
    left = len(sets)
    for first in range(len(sets)):
        if not waiting[first]:
            continue
        waiting[first], left, reached = False, left - 1, [first]
        while reached and left:
            if 2 * left <= len(held):
                flat, held = flat[np.repeat(waiting[held], size[held])], held[waiting[held]]
                starts = np.concatenate([[0], np.cumsum(size[held])])[:-1]
            one = reached.pop()
            table[members[at[one] : at[one + 1]]] = True
            alike = np.add.reduceat(table[flat], starts, dtype=np.int64) / np.sqrt(size[held] * float(size[one]))
            table[members[at[one] : at[one + 1]]] = False
            new = (alike >= least_similarity - 1e-12) & waiting[held]
            found = held[new][np.argsort(alike[new], kind="stable")]  # the most similar goes next
            waiting[found], root[found], left = False, first, left - len(found)
            reached.extend(found.tolist())
    return root


def candidates(rows: DataFrame, most: int) -> DataFrame:
    """(a, b): links by which rows (row, full, samples) of the same sample or of near fingerprints are connected."""
    keys = rows.select("row", F.posexplode("samples").alias("kind", "fp")).union(rows.select("row", F.lit(-1).alias("kind"), F.col("full").alias("fp")))
    ends = keys.groupBy("kind", "fp").agg(F.min("row").alias("b"), F.max("row").alias("high")).where("b <> high").drop("high")
    starred = keys.join(ends, ["kind", "fp"]).select(F.col("row").alias("a"), "b").where("a <> b")
    reps = rows.groupBy(F.col("full").alias("fp")).agg(F.min("row").alias("rep"))
    near = hamming_links(rows.select(F.col("full").alias("fp")), most)
    near = near.join(reps.toDF("a", "ra"), "a").join(reps.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return starred.union(near)


def similar_links(docs: DataFrame, size: int = 5, most: int = 3, least_similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (row, doc_id, text) with rep, the least row of equal text, and the links (a, b) among reps.

    Candidates are rows whose SimHashes differ in at most most bits or that share a sample's SimHash, and all that are
    so connected form a cluster.  Within a cluster the sets of shingles are compared whole: (a, b) gives the closure of
    all its pairs whose cosine similarity, which is what SimHashes estimate, is large enough.  A cluster with more
    than CLUSTER_ROWS rows or CLUSTER_SHINGLES shingles is dealt into blocks and compared by pairs of blocks, so
    that no task holds more.  Texts without a word have one rep, and no links.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for b in batches:
            out = []
            for t in b.column(2).cast(pa.large_binary()).to_pylist():
                sha = hashlib.sha256(t).digest() if t and t.split() else b""
                if sha not in seen:
                    seen = {} if len(seen) > 4096 else seen
                    seen[sha] = (sha, *profile(t, size)) if sha else (sha, 0, [], 0)
                out.append(seen[sha])
            sha, full, samples, n = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(sha, pa.binary()), pa.array(full, pa.int64()), pa.array(samples, pa.list_(pa.int64())), pa.array(n, pa.int64())], names=["row", "doc_id", "sha", "full", "samples", "shingles"])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby("cluster", sort=False):
            ids = part["row"].to_numpy()
            root = closure([shingle_set(t.encode(), size) for t in part["text"]], least_similarity)
            linked = root != np.arange(len(ids))
            out.append(pd.DataFrame({"a": ids[linked], "b": ids[root[linked]]}))
        return pd.concat(out)

    texts = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = materialize(texts.mapInArrow(run, "row long, doc_id long, sha binary, full long, samples array<bigint>, shingles long"), "profiles")
    firsts = profiles.groupBy("sha").agg(F.min("row").alias("rep"))
    same = materialize(profiles.select("row", "doc_id", "sha").join(firsts, "sha").select("row", "doc_id", "rep"), "texts")
    reps = same.where("row = rep").select("row")
    rows = materialize(profiles.where("shingles > 0").join(reps, "row", "left_semi").select("row", "full", "samples", "shingles"), "reps")
    clusters = connected_components(candidates(rows, most)).select(F.col("node").alias("row"), F.col("component").alias("cluster"))
    held = materialize(rows.select("row", "shingles").join(clusters, "row"), "clusters")
    sizes = held.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
    blocks = F.ceil(F.greatest(F.col("n") / CLUSTER_ROWS, F.col("s") / CLUSTER_SHINGLES)).cast("int")
    sizes = materialize(sizes.select("cluster", "s", blocks.alias("blocks")), "cluster-sizes")
    total = sizes.where("blocks = 1").agg(F.sum("s")).first()[0] or 0
    bins = max(1, math.ceil(total / CLUSTER_SHINGLES))
    sized = held.join(sizes.drop("s"), "cluster").withColumn("mine", F.pmod(F.xxhash64("row"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != F.col("mine"))
    pairs = F.transform(others, lambda i: F.struct(F.col("cluster").alias("c"), F.least("mine", i).cast("long").alias("i"), F.greatest("mine", i).cast("long").alias("j")))
    pooled = F.array(F.struct(F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("c"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j")))
    dealt = materialize(sized.select("row", "cluster", F.explode(F.when(F.col("blocks") == 1, pooled).otherwise(pairs)).alias("shard")), "dealt")
    links = texts.select("row", "text").join(dealt, "row").groupBy("shard").applyInPandas(link, "a long, b long")
    return same, materialize(links.distinct(), "links")


def deduplicate(docs: DataFrame, size: int = 5, most: int = 3, least_similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id (nulls last); the columns stay.

    Near copies have at least that cosine similarity of their shingles of size words.  Null and empty texts and those
    without a word form one group; a text of fewer words than size is one shingle.  Repeated rows are copies; ties of
    doc_id go to the earlier row; an empty table gives an empty result.
    """
    own = unused(docs.columns, "_row")
    rows = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "documents")
    same, links = similar_links(rows.select(F.col(own).alias("row"), "doc_id", "text"), size, most, least_similarity)
    parts = connected_components(links).withColumnRenamed("node", "rep")
    grouped = materialize(same.join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("row"))
    stays = grouped.groupBy("component").agg(F.min(place).alias("first"))
    gone = materialize(grouped.join(stays, "component").where("row <> first.row").select(F.col("row").alias(own)), "gone")
    return rows.join(gone, own, "left_anti").drop(own)
