"""Katz backoff model of n-grams: Good-Turing discounts, exactly normalised backoff weights, partitioned tables.

Texts are held as chunks of about CHUNK tokens: the sorted hashes of the chunk's words (64 bits; equal hashes
count as equal words), and each document's words as ranks by their number in the chunk, which take fewest bytes.  One exchange an order goes between the chunks and
partitioned count tables, each in compressed arrays instead of a row per n-gram:

1. Unigrams by range of the word's hash: a chunk learns the id and training count of each of its words.
2. N-grams of two, three, ... words by hash of their context: a chunk learns the training count of each of its n-grams, its
   id, which names the context of the next order, and, by context, how many n-grams have each small count and the
   probability, under the order below, of the words seen after it.

A context of more than a HOT-th of all tokens is dealt by context and word; its sums are added up apart (there
are at most HOT of them).  Every token is then evaluated recursively: the n-gram's discounted share, or else its context's
backoff weight times the probability of the order below, down to the class of unknown words.  A task holds a chunk's
tokens and the n-grams of one order; sums by context are held for one partition's answer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, drop, materialize, settings, small_batches

#: Tokens of a chunk, tokens for each partition of a count table, contexts that are dealt by word too.
CHUNK, ENTRIES, HOT = 2_000_000, 500_000, 4_096
#: Words of an n-gram.
ORDER = 3
#: Counts up to K are discounted.
K = 5
START, END = 1, 2  # in place of hashes; they sort first


def squeeze(a: np.ndarray) -> bytes:
    """An array as bytes, by planes and compressed; whole numbers, none of which is negative, in as few bytes as the largest takes."""
    if not len(a):
        return b""
    raw = np.ascontiguousarray(a if a.dtype.kind == "f" else a.astype(np.min_scalar_type(int(a.max())), copy=False))
    return bytes([raw.itemsize]) + zstandard.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T).tobytes(), 1)


def unsqueeze(b: bytes, kind: type) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    raw = np.ascontiguousarray(np.frombuffer(zstandard.decompress(b[1:]), np.uint8).reshape(b[0], -1).T).reshape(-1)
    return raw.view(kind) if np.dtype(kind).kind == "f" else raw.view(f"u{b[0]}").astype(kind, copy=False)


def steps(a: np.ndarray) -> bytes:
    """An ascending array of whole numbers as bytes, by its steps."""
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def unsteps(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b, np.uint64), dtype=np.uint64)


def _least(a: np.ndarray) -> np.ndarray:
    """Whole numbers, none of which is negative, in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8, copy=False)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def chunk_table(docs: DataFrame, chunk_tokens: int = CHUNK) -> DataFrame:
    """docs (doc_id, text, train) as chunks: ids and flags of documents, their lengths, tokens (ranks), places of ranks among words, words, training counts."""
    small_batches(docs.sparkSession)
    names = ["chunk", "doc_ids", "train", "lengths", "tokens", "places", "words", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial = TaskContext.get().partitionId() << 24, 0
        ids, doc_ids, train, tokens, total = _Ids(), [], [], [], 0

        def close() -> pa.RecordBatch:
            words = list(ids)
            hashes = np.array([START, END, *(xxhash.xxh64_intdigest(w) for w in words)], np.uint64)
            order, place = np.argsort(hashes, kind="stable"), np.empty(len(hashes), np.int64)
            place[order] = np.arange(len(hashes))
            lengths = np.array([len(t) + 1 for t in tokens], np.int64)
            flat = np.concatenate([np.append(t + 2, 1) for t in tokens])
            flat = place[flat].astype(np.uint32)
            counts = np.bincount(flat[np.repeat(np.array(train, bool), lengths)], minlength=len(hashes)).astype(np.uint32)
            places = np.argsort(-np.bincount(flat, minlength=len(hashes)), kind="stable")  # frequent words first
            rank = np.empty(len(places), np.uint32)
            rank[places] = np.arange(len(places))
            row = [base + serial, doc_ids, train, squeeze(lengths), squeeze(rank[flat]), squeeze(places), squeeze(hashes[order]), squeeze(counts)]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            for doc_id, text, flag in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.lower().split() if text else []  # bytes know ASCII only
                tokens.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
                doc_ids.append(doc_id)
                train.append(flag)
                total += len(words) + 1
                if total >= chunk_tokens:
                    yield close()
                    serial += 1
                    ids, doc_ids, train, tokens, total = _Ids(), [], [], [], 0
        if tokens:
            yield close()

    schema = "chunk long, doc_ids array<bigint>, train array<boolean>, lengths binary, tokens binary, places binary, words binary, counts binary"
    return docs.select("doc_id", "text", "train").mapInArrow(run, schema)


def discounts(n: list[int]) -> list[float]:
    """Katz's d_1..d_K from the numbers of n-grams with counts 1..K+1.

    Where these don't give ratios strictly between 0 and 1 (few data), an absolute discount takes their place.
    """
    try:
        a = (K + 1) * n[K] / n[0]
        d = [((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a) for r in range(1, K + 1)]
        if all(0 < x < 1 for x in d):
            return d
    except ZeroDivisionError:
        pass
    off = min(0.9, max(0.1, n[0] / (n[0] + 2 * n[1]))) if n[0] else 0.5
    return [(r - off) / r for r in range(1, K + 1)]


def _discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    table = np.array([0.0, *d, 1.0])
    return counts * table[np.minimum(counts, K + 1)]


class Unigrams:
    """P(word) from its count, and that of the one class of unknown words; they add up to 1."""

    def __init__(self, n: int, v: int, by_count: list[int]):
        self.n, self.v, self.d = n, v, discounts(by_count)
        kept = n - sum(r * c * (1 - d) for r, c, d in zip(range(1, K + 1), by_count, self.d, strict=False))
        self.scale = 1 / max(1, n) if kept < n else 1 / (n + 1)
        self.unknown = 1 - kept * self.scale

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, _discounted(counts, self.d) * self.scale, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 under additive smoothing by 0.1."""
        return np.log10((counts + 0.1) / (self.n + 0.1 * (self.v + 1)))


def context_weights(small: np.ndarray, large: np.ndarray, seen: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """By context: the factor of a discounted count, and the backoff weight.

    small: numbers of bigrams with counts 1..K, a row each; large: sum of larger counts; seen: unigram
    probability of the words seen after the context.  A context never seen backs off with weight 1.
    """
    r = np.arange(1, K + 1)
    total = small @ r + large
    kept = small @ (r * np.array(d)) + large
    factor = np.where(kept < total, 1 / np.maximum(total, 1), 1 / (total + 1))
    weight = np.where(total > 0, (1 - kept * factor) / np.maximum(1 - seen, 1e-12), 1.0)
    return factor, weight


def _grams(before: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unique (context, word) of a chunk, a token that each is at, and for each token its place in them.

    As numpy.unique does it, but with no more than four arrays of the tokens' length at a time.
    """
    keys = before.astype(np.uint64)
    keys <<= np.uint64(32)
    keys |= tokens
    order = np.argsort(keys).astype(np.int32)  # places in a chunk
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    at, keys = order[new], keys[new]
    return (keys >> np.uint64(32)).astype(np.int32), keys.astype(np.uint32).view(np.int32), at, inverse


def _shifted(local: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
    """For each token what local has for the one before it; start at the first token of a text."""
    before = np.empty(len(local), np.int32)
    before[1:] = local[:-1]
    before[starts] = start
    return before


def _placed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id its place in ascending order, and the order."""
    order = np.argsort(ids)
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids))
    return place, order


def _unseen(counts: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which contexts, whose n-grams start at heads, have an n-gram without a count, so that their backoff weight is asked."""
    return np.minimum.reduceat(counts, heads) == 0 if len(heads) else np.zeros(0, bool)


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ (a >> np.uint64(29))


def _parts(contexts: np.ndarray, context: np.ndarray, word: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """Partition of each n-gram, by the id of its context, whose place in contexts it has; by context and word for hot contexts (and the start of a text)."""
    spread = _mix(contexts)[context]
    split = np.isin(contexts, hot)[context]
    spread[split] = _mix(spread[split] + word[split] + np.uint64(1))
    return (spread % np.uint64(n)).astype(np.min_scalar_type(n))  # sixteen bits are sorted faster


#: kind is the order; a, b, c and e hold ids and counts of words, or counts, sums by context, ids of n-grams, and what follows contexts.
ANSWER = "chunk long, part long, kind int, a binary, b binary, c binary, e binary, n array<bigint>, hot array<bigint>, hot_n array<bigint>, sums array<double>"


def _answer(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["chunk", "part", "kind", "a", "b", "c", "e", "n", "hot", "hot_n", "sums"])


def _unigram_answers(chunks: DataFrame, parts: int, least_hot: float) -> DataFrame:
    """By chunk and range of hashes: ids (a) and training counts (b) of its words; and sums, as chunk -1."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, counts = unsqueeze(words, np.uint64), unsqueeze(counts, np.uint32)
                part = ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
                spans = list(zip(edges[:-1], edges[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[i]) for i, _ in spans], pa.int64()), pa.array([chunk] * len(spans), pa.int64()), pa.array([squeeze(words[i:j]) for i, j in spans], pa.binary()), pa.array([squeeze(counts[i:j]) for i, j in spans], pa.binary())],
                    names=["part", "chunk", "words", "counts"],
                )

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words = [unsqueeze(b, np.uint64) for b in rows["words"]]
        unique, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unsqueeze(b, np.uint32) for b in rows["counts"]])).astype(np.int64)
        rank = np.empty(len(unique), np.int64)
        rank[np.lexsort((unique, -total))] = np.arange(len(unique))  # frequent words get small ids
        ids = (rank * parts + int(key[0])).astype(np.uint64)
        ids[unique == START] = parts * (1 << 40)
        out, at = [], 0
        for chunk, w in zip(rows["chunk"], words, strict=True):
            mine = inverse[at : at + len(w)]
            at += len(w)
            out.append((chunk, int(key[0]), 1, squeeze(ids[mine]), squeeze(total[mine]), None, None, None, None, None, None))
        n = [int(total.sum()), int(np.count_nonzero(total)), *(int(np.count_nonzero(total == r)) for r in range(1, K + 2))]
        often = total > least_hot
        out.append((-1, int(key[0]), 1, None, None, None, None, n, None, ids[often].astype(np.int64).tolist(), None))
        return _answer(out)

    dealt = chunks.select("chunk", "words", "counts").mapInArrow(deal, "part long, chunk long, words binary, counts binary")
    return dealt.groupBy("part").applyInPandas(merge, ANSWER)


class Order:
    """What all chunks need to know of an order of n-grams: its discounts, its hot contexts and their sums."""

    def __init__(self, hot: np.ndarray):
        self.hot, self.d = hot, [0.0] * K
        self.hot_ids, self.hot_sums = np.zeros(0, np.uint64), np.zeros((0, K + 2))


class Chunk:
    """A chunk's tokens, taken order by order through the answers of the count tables; with probabilities if scored."""

    def __init__(self, row: dict, answers: pd.DataFrame, uni: Unigrams, parts: int, scored: bool):
        self.answers, self.parts, self.scored = answers, parts, scored
        own = self._own(1)
        ids = np.concatenate([unsqueeze(b, np.uint64) for b in own["a"]])
        place, order = _placed(ids)
        self.ids, self.totals = ids[order], _least(np.concatenate([unsqueeze(b, np.int64) for b in own["b"]])[order])
        self.tokens = place[unsqueeze(row["places"], np.uint32)].view(np.uint32)[unsqueeze(row["tokens"], np.uint32)]
        self.lengths = unsqueeze(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # by token: the training count of the n-gram that ends there, its context's factor, its probability
        self.counts = self.totals[self.tokens]
        if scored:
            self.factor, self.chance = np.full(len(self.tokens), uni.scale), uni.of(self.totals)[self.tokens]
        # the contexts of the next order: a place among contexts for each token, and the contexts' ids, ascending
        self.before, self.contexts = _shifted(self.tokens, self.starts, place[0]), self.ids

    def _own(self, kind: int) -> pd.DataFrame:
        return self.answers[self.answers["kind"] == kind].sort_values("part")

    def grams(self, order: Order) -> None:
        """The chunk's n-grams of the next order, dealt to partitions."""
        self.context, self.word, self.at, self.inverse = _grams(self.before, self.tokens)
        part = _parts(self.contexts, self.context, self.ids[self.word], order.hot, self.parts)
        self.dealt = np.argsort(part, kind="stable").astype(np.int32)  # by context and word in each
        sizes = np.bincount(part, minlength=self.parts)
        self.spans = [(i, self.dealt[end - n : end]) for i, (n, end) in enumerate(zip(sizes.tolist(), np.cumsum(sizes).tolist(), strict=True)) if n]

    def step(self, kind: int, order: Order, last: bool) -> None:
        """Take all tokens through that order, whose answers are there: counts, names unless it is the last, and probabilities if scored."""
        self.grams(order)
        counts = np.empty(len(self.context), np.int64)
        names = None if last else np.empty(len(self.context), np.uint64)
        if self.scored:
            scale = np.zeros(len(self.contexts))
            scale[self.before] = self.factor  # the tokens after a context share that of the order below
            below, chance, factor = self.chance[self.at], np.empty(len(self.context)), np.ones(len(self.contexts))
            shared = np.isin(self.contexts, order.hot_ids)
        own = self._own(kind)
        for (part, span), a, b, c, e in zip(self.spans, own["a"], own["b"], own["c"], own["e"], strict=True):
            here = unsqueeze(a, np.int64)
            counts[span] = here
            if not last:
                names[span] = unsteps(c) * np.uint64(self.parts) + np.uint64(part)
            if self.scored:  # a context that is not shared lies whole in its partition
                context = self.context[span]
                new = np.diff(context, prepend=-1) != 0
                heads, of = np.flatnonzero(new), np.cumsum(new) - 1
                which, sums = context[heads], np.zeros((len(heads), K + 2))
                sums[:, : K + 1] = unsqueeze(b, np.int64).reshape(K + 1, -1).T
                sums[_unseen(here, heads), K + 1] = unsqueeze(e, np.float64)
                hot = np.flatnonzero(shared[which])
                if len(hot):
                    sums[hot] = order.hot_sums[np.searchsorted(order.hot_ids, self.contexts[which[hot]])]
                factor[which], weight = context_weights(sums[:, :K], sums[:, K], sums[:, K + 1] * scale[which], order.d)
                chance[span] = np.where(here > 0, _discounted(here, order.d) * factor[context], weight[of] * below[span])
        if self.scored:
            self.chance, self.factor = np.maximum(chance, 1e-300)[self.inverse], factor[self.before]
        self.counts = _least(counts)[self.inverse]
        inverse, self.context, self.word, self.at, self.inverse, self.dealt, self.spans = self.inverse, *[None] * 6  # the next order's take their place
        if not last:  # the n-gram that ends at a token is the context of the token after it; at a text's start, one of its own
            names = np.append(names, np.uint64(self.parts * ((1 << 40) + kind)))
            place, o = _placed(names)
            self.before, self.contexts = _shifted(place[inverse], self.starts, place[-1]), names[o]


def _answered(chunks: DataFrame, table: DataFrame) -> DataFrame:
    """chunks with the answers of a further order beside those they have."""
    told = table.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("part", "kind", "a", "b", "c", "e")).alias("_told"))
    answers = F.concat("answers", "_told") if "answers" in chunks.columns else F.col("_told")
    return chunks.join(told, "chunk").select("chunk", "doc_ids", "train", "lengths", "tokens", "places", answers.alias("answers"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):  # one at a time, as a chunk is large
            yield b.slice(i, 1).to_pylist()[0]


def _replayed(row: dict, uni: Unigrams, parts: int, orders: list[Order], scored: bool) -> Chunk:
    """The chunk taken through all orders so far: scored, or else named for a further one."""
    chunk = Chunk(row, pd.DataFrame(row.pop("answers")), uni, parts, scored)
    for i, order in enumerate(orders):
        chunk.step(i + 2, order, last=scored and i == len(orders) - 1)
    return chunk


def _gram_answers(chunks: DataFrame, parts: int, uni: Unigrams, orders: list[Order], hot: np.ndarray, least_hot: float, last: bool) -> DataFrame:
    """By chunk and partition: training counts of its n-grams of the next order (a), sums by context (b), ids in the partition (c); and sums, as chunk -1."""
    kind = len(orders) + 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            out, chunk = [], _replayed(row, uni, parts, orders, False)
            chunk.grams(Order(hot))
            train = np.repeat(np.array(row["train"], bool), chunk.lengths)
            counts = np.bincount(chunk.inverse[train], minlength=len(chunk.context)).astype(np.uint32)
            # of what was seen, the share under the order below is the discounted count times a factor that the chunks have
            below = chunk.counts[chunk.at]
            for part, o in chunk.spans:
                out.append((part, row["chunk"], steps(chunk.contexts[chunk.context[o]]), squeeze(chunk.ids[chunk.word[o]]), squeeze(counts[o]), squeeze(below[o])))
            kinds = [pa.int64()] * 2 + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "chunk", "contexts", "words", "counts", "below"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = [unsqueeze(b, np.uint32) for b in rows["counts"]]
        sizes = [len(c) for c in counts]
        context = np.concatenate([unsteps(b) for b in rows["contexts"]])
        word = np.concatenate([unsqueeze(b, np.uint64) for b in rows["words"]])
        order = np.lexsort((word, context))
        new = np.ones(len(order), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
        firsts = order[new]
        pair = np.empty(len(order), np.int32)
        pair[order] = np.cumsum(new, dtype=np.int32) - 1
        del order, new, word
        total = np.bincount(pair, np.concatenate(counts)).astype(np.int64)
        below = _discounted(np.concatenate([unsqueeze(b, np.int64) for b in rows["below"]])[firsts], orders[-1].d if orders else uni.d)
        own, of = np.unique(context[firsts], return_inverse=True)
        sums = np.zeros((len(own), K + 2))
        for r in range(1, K + 1):
            sums[:, r - 1] = np.bincount(of, total == r, len(own))
        sums[:, K] = np.bincount(of, np.where(total > K, total, 0), len(own))
        sums[:, K + 1] = np.bincount(of, np.where(total > 0, below, 0.0), len(own))
        names = np.arange(len(firsts), dtype=np.uint64) * np.uint64(parts) + np.uint64(key[0])
        out, at = [], 0
        for chunk, size in zip(rows["chunk"], sizes, strict=True):
            mine = pair[at : at + size]
            heads = np.flatnonzero(np.diff(of[mine], prepend=-1))
            at += size
            here, own_sums = total[mine], sums[of[mine][heads]]
            asked = own_sums[_unseen(here, heads), K + 1]
            out.append((chunk, int(key[0]), kind, squeeze(here), squeeze(own_sums[:, : K + 1].T.reshape(-1).astype(np.int64)), None if last else steps(mine.astype(np.uint64)), squeeze(asked), None, None, None, None))
        shared, often = np.isin(own, hot), total > least_hot
        n = [int(np.count_nonzero(total == r)) for r in range(1, K + 2)]
        out.append((-1, int(key[0]), kind, None, None, None, None, n, own[shared].astype(np.int64).tolist(), [] if last else names[often].astype(np.int64).tolist(), sums[shared].reshape(-1).tolist()))
        return _answer(out)

    schema = "part long, chunk long, contexts binary, words binary, counts binary, below binary"
    return chunks.select("chunk", "train", "lengths", "tokens", "places", "answers").mapInArrow(deal, schema).groupBy("part").applyInPandas(merge, ANSWER)


def _ids(table: DataFrame, column: str) -> list[int]:
    """The distinct ids of a column of the sums; HOT at most, by what makes a context hot."""
    return [r[0] for r in table.where("chunk = -1").select(F.explode(column).alias("id")).distinct().collect()]


def _told(table: DataFrame, hot: np.ndarray) -> Order:
    """The discounts and the hot contexts' sums of an order's answers."""
    order = Order(hot)
    sums = table.where("chunk = -1").agg(*[F.sum(F.col("n")[i]) for i in range(K + 1)]).first()
    order.d = discounts([int(x or 0) for x in sums])
    slots = table.where("chunk = -1").select(F.posexplode("hot").alias("i", "id"), "sums").groupBy("id").agg(*[F.sum(F.col("sums")[F.col("i") * (K + 2) + k]).alias(f"s{k}") for k in range(K + 2)]).collect()
    ids = np.array([r[0] for r in slots], np.int64).view(np.uint64)
    by_id = np.argsort(ids)
    order.hot_ids, order.hot_sums = ids[by_id], np.array([r[1:] for r in slots], float).reshape(len(slots), K + 2)[by_id]
    return order


def katz_scores(docs: DataFrame, held_out_mod: int = 10, chunk_tokens: int = CHUNK, entries: int = ENTRIES, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row, by n-grams of order words.

    Learns from the documents whose crc32(doc_id as text) mod held_out_mod is not 0 (null ids train).  A null
    or empty text is its end token alone.  Repeated rows count and are scored each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(crc_mod("doc_id", held_out_mod) != 0, F.lit(True)).alias("train"))
    with settings(spark, codec="uncompressed"):  # arrays are compressed; a codec would hold all rows of a task once more
        chunks = materialize(chunk_table(rows, chunk_tokens), "lm-chunks")
    size = chunks.select("train", "lengths").mapInArrow(_sizes, "train long, tokens long").agg(F.sum("train"), F.sum("tokens")).first()
    parts = max(1, -(-(size[1] or 0) // entries))
    least_hot = (size[0] or 0) / HOT
    with settings(spark, codec="uncompressed", rows="1"):  # a row holds a chunk
        first = materialize(_unigram_answers(chunks, parts, least_hot), "lm-unigrams")
    sums = first.where("chunk = -1").agg(*[F.sum(F.col("n")[i]) for i in range(K + 3)]).first()
    uni = Unigrams(int(sums[0] or 0), int(sums[1] or 0), [int(x or 0) for x in sums[2:]])
    orders: list[Order] = []
    hot = np.array([*_ids(first, "hot_n"), parts * (1 << 40)], np.int64).view(np.uint64)
    table = first
    for kind in range(2, order + 1):
        # what chunks have been told lies with them, once
        with settings(spark, codec="uncompressed", rows="1"):
            chunks, gone = materialize(_answered(chunks, table), f"lm-told{kind}"), [chunks, table]
            drop(*gone)
            table = materialize(_gram_answers(chunks, parts, uni, orders, hot, least_hot, kind == order), f"lm-grams{kind}")
        orders = [*orders, _told(table, hot)]
        hot = np.array([*_ids(table, "hot_n"), parts * ((1 << 40) + kind)], np.int64).view(np.uint64)

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        row["answers"] = [*row.get("answers", []), *answers.to_pylist()]
        chunk = _replayed(row, uni, parts, orders, True)
        seen = chunk.totals[chunk.tokens]
        columns = {
            "doc_id": pa.array(row["doc_ids"], pa.int64()),
            "held_out": pa.array(~np.array(row["train"], bool)),
            "n_tokens": pa.array(chunk.lengths),
            "n_known": pa.array(np.add.reduceat((seen > 0).astype(np.int64), chunk.starts)),
            "train_tokens": pa.array(np.full(len(chunk.lengths), uni.n)),
            "base_score": pa.array(np.add.reduceat(uni.base(chunk.totals)[chunk.tokens], chunk.starts)),
            "score": pa.array(np.add.reduceat(np.log10(chunk.chance), chunk.starts)),
        }
        return pa.table(columns)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    told = table.where("chunk >= 0").select("chunk", "part", "kind", "a", "b", "c", "e")
    # the last order's answers stay rows of their own: joined, a task's chunks would be held whole, several times over
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, schema)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training tokens and all tokens of chunks."""
    for b in batches:
        lengths = [(np.array(t, bool), unsqueeze(x, np.int64)) for t, x in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([int(x[t].sum()) for t, x in lengths], pa.int64()), pa.array([int(x.sum()) for _, x in lengths], pa.int64())], names=["train", "tokens"])
