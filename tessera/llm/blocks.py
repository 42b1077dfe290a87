"""Words of whole texts, cut block by block with NumPy and Arrow inside Spark's tasks.

A block is some rows of a task, closed once it holds BLOCK bytes of text, so a task's memory is bounded by a block and
the longest text, whatever a partition holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text from which a block is closed.
BLOCK = 4 << 20
#: A-Z as a-z; bytes of other letters stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Kinds of a byte: part of a word, between words, between pieces.
IN_WORD, BETWEEN, BREAK = 0, 1, 2


def kinds(between: bytes, breaks: bytes = b"") -> np.ndarray:
    table = np.full(256, IN_WORD, np.uint8)
    table[list(between)] = BETWEEN
    table[list(breaks)] = BREAK
    return table


def blocks(batches: Iterator[pa.RecordBatch], text: str, size: int | None = None) -> Iterator[pa.Table]:
    """The rows of a task by blocks; null texts are empty ones."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            held.append(part)
            n += part.column(part.schema.get_field_index(text)).nbytes
            if n >= (size or BLOCK):
                yield pa.Table.from_batches(held)
                held, n = [], 0
                pa.default_memory_pool().release_unused()  # workers are kept, and what they hold with them
    if held:
        yield pa.Table.from_batches(held)


def words_of(texts: pa.ChunkedArray, kind: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, ids, rows, pieces): the distinct lower-cased words, and for each word in order its place among them,
    the row of its text and the number of its piece; pieces end at breaks and at the end of a text."""
    column = pa.concat_arrays(texts.cast(pa.large_string()).chunks).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    what = kind[data]
    breaks = what == BREAK
    inside = what == IN_WORD
    del what
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    breaks |= edge[:-1]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, lengths = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lengths -= starts
    del begins, ends, edge
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=places[1:])
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(LOWER[data[inside]])]).dictionary_encode()
    rows = (np.searchsorted(offsets, starts, side="right") - 1).astype(np.int32)
    pieces = np.searchsorted(np.flatnonzero(breaks), starts, side="right").astype(np.int32)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), rows, pieces


def codes(*columns: pa.ChunkedArray) -> tuple[list[pa.Array], np.ndarray]:
    """(the columns of the distinct combinations, the place of each row among them); columns are without nulls."""
    group = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        coded = pa.concat_arrays(column.chunks).dictionary_encode()
        group = group * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    return [pa.concat_arrays(column.take(pa.array(first)).chunks) for column in columns], group
