"""Pairs of alike sets among those that lie in memory together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .scoring import flat, places

#: A pair is followed up if its rarest tokens have one more in common for each SPARE tokens of the smaller set.
SPARE = 32
#: Shares are decimals of few places, which a product of doubles may miss.
EPSILON = 1e-6
#: Meetings of sets at a token that are held at once.
MEETINGS = 2_000_000


def pieces(sizes: np.ndarray) -> Iterator[slice]:
    """Ranges of rows with about MEETINGS of size together, a row at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEETINGS, "right")))
        yield slice(at, end)
        at = end


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places from each start on, as many as its size."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def alike(ids: np.ndarray, sides: np.ndarray, sets: pa.ListArray, apart: bool, least: float, long: int | None, least_long: float | None, contained: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(p, q) of the alike ones, the smaller first, as told of alike_sets; if apart, only pairs of different sides."""
    share = min(x for x in (least, least_long, contained) if x is not None)
    row, tokens = flat(sets)
    code, df = np.unique(tokens.to_numpy(), return_inverse=True, return_counts=True)[1:]
    many, code = len(df), np.argsort(np.argsort(df, kind="stable"))[code]  # the rarest first
    df = np.sort(df, kind="stable")
    held = np.sort(row * many + code)  # by set, its rarest tokens first
    row, code = held // many, held % many
    size = np.bincount(row, minlength=len(ids))
    start = np.cumsum(size) - size
    k = size // SPARE + 1
    first = size - np.ceil(share * size - EPSILON).astype(np.int64) + k
    posted = np.flatnonzero((places(row) < first[row]) & (df[code] > 1))
    by_token = np.argsort(code, kind="stable")
    token_start = np.searchsorted(code[by_token], np.arange(many))
    row_of = row[by_token]
    out = [(ids[:0], ids[:0])]
    bounds = np.flatnonzero(np.r_[True, row[posted][1:] != row[posted][:-1]][: len(posted)])  # a set's meetings are counted together
    met = np.add.reduceat(df[code[posted]], bounds) if len(bounds) else np.zeros(0, np.int64)
    ends = np.r_[bounds[1:], len(posted)]
    for piece in pieces(met):
        at = posted[bounds[piece.start] : ends[piece.stop - 1]]
        p, q = np.repeat(row[at], df[code[at]]), row_of[spread(token_start[code[at]], df[code[at]])]
        fit = (size[p] < size[q]) | ((size[p] == size[q]) & (ids[p] < ids[q]))
        if apart:
            fit &= sides[p] != sides[q]
        if contained is None:
            fit &= size[p] >= share * size[q] - EPSILON
        pairs, hits = np.unique(p[fit] * len(ids) + q[fit], return_counts=True)
        pairs = pairs[hits >= k[pairs // len(ids)]]
        for part in pieces(size[pairs // len(ids)]):
            p, q = pairs[part] // len(ids), pairs[part] % len(ids)
            asked = np.repeat(q, size[p]) * many + code[spread(start[p], size[p])]
            found = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked
            c = np.add.reduceat(found, np.cumsum(size[p]) - size[p], dtype=np.int64) if len(p) else np.zeros(0, np.int64)
            m, n = size[p], size[q]
            wanted = least if least_long is None else np.where(m >= long, least_long, least)
            good = c >= wanted * (m + n - c) - EPSILON
            if contained is not None:
                good |= c >= contained * m - EPSILON
            out.append((ids[p[good]], ids[q[good]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def compared(apart: bool, least: float, long: int | None, least_long: float | None, contained: float | None) -> Callable[[pa.Table], pa.Table]:
    """alike() of a group's rows (id, side, set) as rows (p, q)."""

    def pairs(rows: pa.Table) -> pa.Table:
        ids, sides = rows.column("id").to_numpy(), rows.column("side").to_numpy()
        p, q = alike(ids, sides, rows.column("set").combine_chunks(), apart, least, long, least_long, contained)
        return pa.table({"p": p, "q": q})

    return pairs
