"""What tasks do with the terms of documents, by Arrow batches: count those that are asked for, and leave out what can't be among the first k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

#: Documents of a batch.
ROWS = 1024
#: Postings that a task puts into blocks at once, by how many documents it takes them, and blocks that it gives back at once.
SEGMENT, STEP, BATCH = 500_000, 64, 50_000
#: The number of a block has its task from the first bit on, its segment in the task from the second, and its place below.
PART_BIT, SEGMENT_BIT = 44, 24
#: Scores of documents and queries that are held at once.
CELLS = 1 << 21
#: Places by which scores are told apart, and what two ways of summing a score may differ by, as a share and in the last place.
PLACES, SHARE, LAST = 9, 1e-13, 1e-3


def small_batches(rows: DataFrame) -> None:
    """Documents go to Python this many at a time, as each has all its tokens with it; the session's setting is lowered and stays so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(rows.sparkSession.conf.get(name))
    rows.sparkSession.conf.set(name, str(min(now, ROWS) if now > 0 else ROWS))


def flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each element, and the elements."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def listed(rows: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    """Values as lists of n rows; rows ascend."""
    ends = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def terms_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, place among the distinct elements and number of times of each row's distinct elements, by row; the distinct elements."""
    row, elements = flat(lists)
    coded = elements.dictionary_encode(null_encoding="encode")
    many = max(1, len(coded.dictionary))
    pairs, times = np.unique(row * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return pairs // many, pairs % many, times, coded.dictionary


def places_of(elements: pa.Array, words: pa.Array) -> np.ndarray:
    """The places of elements among words, -1 where there is none."""
    return pc.fill_null(pc.index_in(elements, value_set=words), -1).to_numpy(zero_copy_only=False)


def counted_words(docs: DataFrame, key: str, tokens: str, words: pa.Array) -> DataFrame:
    """(key, distinct, words, counts) of each row: its number of distinct tokens, and how often it has which of the words, by their places."""
    rows = docs.select(key, F.col(tokens).alias("tokens"))
    small_batches(rows)
    schema = pa.schema([(key, to_arrow_type(rows.schema[key].dataType)), ("distinct", pa.int32()), ("words", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            row, code, times, elements = terms_of(batch.column("tokens"))
            distinct = np.bincount(row, minlength=n).astype(np.int32)
            place = places_of(elements, shared.value)[code]
            order = np.lexsort((place, row))
            order = order[place[order] >= 0]
            row, place, times = row[order], place[order], times[order]
            yield pa.record_batch([batch.column(key), pa.array(distinct), listed(row, n, place), listed(row, n, times)], schema=schema)

    return rows.mapInArrow(counted, from_arrow_schema(schema))


def term_lists(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, tokens, counts) of each row: its distinct tokens, and how often it has each."""
    rows = docs.select(F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    small_batches(rows)
    schema = pa.schema([("key", to_arrow_type(rows.schema["key"].dataType)), ("tokens", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, times, elements = terms_of(batch.column("tokens"))
            counts = listed(row, batch.num_rows, times)
            yield pa.record_batch([batch.column("key"), pa.ListArray.from_arrays(counts.offsets, elements.take(pa.array(code))), counts], schema=schema)

    return rows.mapInArrow(counted, from_arrow_schema(schema))


def known_words(terms: DataFrame, words: pa.Array) -> DataFrame:
    """terms (key, source, tokens, counts) as (key, source, distinct, words, counts), with the tokens that are among words by their places."""
    terms = terms.select("key", "source", "tokens", "counts")
    small_batches(terms)
    fields = [(c, to_arrow_type(terms.schema[c].dataType)) for c in ("key", "source")]
    schema = pa.schema([*fields, ("distinct", pa.int32()), ("words", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    shared = terms.sparkSession.sparkContext.broadcast(words)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            row, elements = flat(batch.column("tokens"))
            distinct, place, counts = np.bincount(row, minlength=n).astype(np.int32), places_of(elements, shared.value), batch.column("counts").flatten().to_numpy()
            order = np.lexsort((place, row))
            order = order[place[order] >= 0]
            yield pa.record_batch([batch.column("key"), batch.column("source"), pa.array(distinct), *(listed(row[order], n, x[order]) for x in (place, counts))], schema=schema)

    return terms.mapInArrow(known, from_arrow_schema(schema))


def places(*columns: np.ndarray) -> np.ndarray:
    """The place of each row, from 0, among the rows beside it that are equal in all columns."""
    at = np.arange(len(columns[0]))
    first = np.logical_or.reduce([np.r_[True, c[1:] != c[:-1]][: len(at)] for c in columns])
    return at - np.maximum.accumulate(np.where(first, at, 0))


class Best:
    """Of the documents seen, those that can be among a query's first k, by score rounded to PLACES and then by their first columns."""

    def __init__(self, k: int, n_queries: int, keys: int = 1):
        self.k, self.keys, self.docs = k, keys, None
        self.doc, self.query, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(n_queries, -np.inf)

    def add(self, docs: pa.RecordBatch, scores: np.ndarray) -> None:
        """scores has a row a document and a column a query; scores of 0 and less don't count."""
        doc, query = np.nonzero((scores > 0) & (self._bounds(scores)[1] >= self.least))
        if not len(doc):
            return
        held = 0 if self.docs is None else self.docs.num_rows
        self.doc, self.query, self.score = (np.concatenate(x) for x in ((self.doc, doc + held), (self.query, query), (self.score, scores[doc, query])))
        self.docs = docs if self.docs is None else pa.concat_batches([self.docs, docs])
        self._prune()

    @staticmethod
    def _bounds(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest that a score is when rounded, in units of the last place."""
        units = scores * 10.0**PLACES
        off = LAST + np.abs(units) * SHARE
        return np.floor(units + 0.5 - off), np.floor(units + 0.5 + off)

    def _prune(self) -> None:
        ranks = np.empty(self.docs.num_rows, np.int64)
        ranks[pc.sort_indices(self.docs, [(c, "ascending") for c in self.docs.schema.names[: self.keys]]).to_numpy()] = np.arange(len(ranks))
        order = np.lexsort((ranks[self.doc], -self.score, self.query))
        doc, query, score = self.doc[order], self.query[order], self.score[order]
        keep = places(query, score) < self.k  # of equal scores the least keys
        doc, query, score = doc[keep], query[keep], score[keep]
        low, high = self._bounds(score)
        kth = places(query) == self.k - 1
        self.least[query[kth]] = low[kth]  # scores descend, and so do their bounds
        keep = high >= self.least[query]
        surely = np.flatnonzero(keep & (low == high) & (high == self.least[query]))  # equal when rounded: the least keys of each query
        by_key = surely[np.lexsort((ranks[doc[surely]], query[surely]))]
        keep[by_key[places(query[by_key]) >= self.k]] = False
        doc, self.query, self.score = doc[keep], query[keep], score[keep]
        used, self.doc = np.unique(doc, return_inverse=True)
        self.docs = self.docs.take(pa.array(used))

    def rows(self) -> tuple[pa.RecordBatch, pa.ListArray] | None:
        """The documents that are left, and the queries of each."""
        if self.docs is None:
            return None
        order = np.lexsort((self.query, self.doc))
        return self.docs, listed(self.doc[order], self.docs.num_rows, self.query[order])


def first_of_task(docs: DataFrame, weights: pa.Table, k: int, keys: int = 1) -> DataFrame:
    """docs (keys, distinct, words, counts) with queries, the queries of which a document can be among the first k of its task.

    weights has word, query and weight; words and queries are numbers from 0.  The first k of all are among the rows.
    """
    place, query, weight = (weights.column(c).to_numpy() for c in ("word", "query", "weight"))
    order = np.lexsort((query, place))
    place, query, weight = place[order], query[order], weight[order]
    n_queries, n_words = int(query.max(initial=-1)) + 1, int(place.max(initial=-1)) + 1
    shared = docs.sparkSession.sparkContext.broadcast((np.searchsorted(place, np.arange(n_words + 1)), query, weight))
    fields = [(f.name, to_arrow_type(f.dataType)) for f in docs.schema]
    schema = pa.schema([*fields, ("queries", pa.list_(pa.int32()))])

    def scores(batch: pa.RecordBatch, starts: np.ndarray, query: np.ndarray, weight: np.ndarray) -> np.ndarray:
        row, words = flat(batch.column("words"))
        words, counts = words.to_numpy(), flat(batch.column("counts"))[1].to_numpy()
        known = words < len(starts) - 1
        row, words, counts = row[known], words[known], counts[known]
        sizes = starts[words + 1] - starts[words]
        at = np.repeat(starts[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        sums = np.bincount(np.repeat(row, sizes) * n_queries + query[at], np.repeat(counts, sizes) * weight[at], batch.num_rows * n_queries)
        return sums.reshape(batch.num_rows, n_queries) / np.sqrt(batch.column("distinct").to_numpy() + 1.0)[:, None]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, n_queries, keys)
        step = max(1, CELLS // max(1, n_queries))
        for batch in batches if n_queries else ():
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                best.add(part, scores(part, *shared.value))
        if left := best.rows():
            yield pa.record_batch([*left[0].columns, left[1]], schema=schema)

    return docs.mapInArrow(first, from_arrow_schema(schema))


def blocks_of(terms: DataFrame, size: int, levels: int) -> DataFrame:
    """(token, level, chunk, best, entries, size): the postings of terms (key, tokens, counts), in blocks of at most size.

    A task takes SEGMENT documents at a time.  A block has postings of one token and one level of impact, the best first.
    """
    kind = to_arrow_type(terms.schema["key"].dataType)
    small_batches(terms)
    entry = pa.struct([("key", kind), ("impact", pa.float64())])
    schema = pa.schema([("token", pa.string()), ("level", pa.int32()), ("chunk", pa.int64()), ("best", pa.float64()), ("entries", pa.list_(entry)), ("size", pa.int32())])

    def blocks(segment: pa.Table, chunk: int) -> Iterator[pa.RecordBatch]:
        segment = segment.combine_chunks().to_batches()[0]
        row, tokens = flat(segment.column("tokens"))
        coded = tokens.dictionary_encode(null_encoding="encode")
        impact = segment.column("counts").flatten().to_numpy() / np.sqrt(np.bincount(row, minlength=segment.num_rows)[row] + 1.0)
        code, level = coded.indices.to_numpy(zero_copy_only=False), np.floor(np.log2(impact) * levels).astype(np.int32)
        order = np.lexsort((row, -impact, level, code))
        code, level, impact, row = code[order], level[order], impact[order], row[order]
        place = places(code, level)
        starts = np.flatnonzero(place % size == 0)
        for first in range(0, len(starts), BATCH):
            heads = starts[first : first + BATCH]
            end = starts[first + BATCH] if first + BATCH < len(starts) else len(code)
            ends = np.r_[heads, end]
            held = pa.StructArray.from_arrays([segment.column("key").take(pa.array(row[heads[0] : end])), pa.array(impact[heads[0] : end])], fields=list(entry))
            lists = pa.ListArray.from_arrays(pa.array((ends - heads[0]).astype(np.int32)), held)
            parts = pa.array(chunk + place[heads] // size)
            yield pa.record_batch([coded.dictionary.take(pa.array(code[heads])), pa.array(level[heads]), parts, pa.array(impact[heads]), lists.cast(schema.field("entries").type), pa.array(np.diff(ends).astype(np.int32))], schema=schema)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, postings = TaskContext.get().partitionId() << PART_BIT, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                held.append(part := batch.slice(at, STEP))
                postings += len(part.column("tokens").flatten())
                if postings >= SEGMENT:
                    yield from blocks(pa.Table.from_batches(held), chunk)
                    chunk, held, postings = chunk + (1 << SEGMENT_BIT), [], 0
        if postings:
            yield from blocks(pa.Table.from_batches(held), chunk)

    return terms.mapInArrow(dealt, from_arrow_schema(schema))
