"""Token counts by a map-side two-tier lookup of pre-tokens.

A piece of the vocabulary holds the word mark only as a prefix, so no merge crosses the start of a run of
marks, and none crosses a line feed if no piece but its byte holds one: such pre-tokens are encoded apart and
their lengths add up.  The first tier is a broadcast table of the lengths of frequent pre-tokens, the second a
bounded cache of each Python worker; no pre-token is shuffled to be counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
#: Documents of the sample that the frequent pre-tokens are taken from; it changes the speed, never a count.
SAMPLE_DOCS = 2_000
#: Pre-tokens in the broadcast table, in a worker's cache, and bytes of a pre-token that is cached.
FREQUENT, CACHED, LONGEST = 20_000, 500_000, 64

_PIECES: dict = {}


class PieceCounter(dict):
    """Token counts by pre-token; a miss is encoded and kept until the cache is full, then a new cache starts."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.frequent = frequent or {}
        pieces = [self.model.id_to_piece(i) for i in range(len(self.model))]
        #: Whether pre-tokens may be encoded apart; else whole texts are encoded.
        self.apart = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and all(
            self.model.encode(t, out_type=str) == x for t, x in (("a", [MARK + "a"]), ("\na", [MARK, "<0x0A>", "a"]), (" ", [MARK * 2]))
        )

    def __missing__(self, chunk: str) -> int | None:
        """Tokens of a mark and a chunk without spaces; None for the empty chunk between two spaces and where marks of the text itself stand at an end."""
        n = self.frequent.get(chunk)
        if n is None:
            n = sum(map(self._alone, pretokens(chunk))) if chunk and MARK not in (chunk[0], chunk[-1]) else None
        if len(chunk) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = n
        return n

    def _alone(self, pretoken: str) -> int:
        """Tokens of a pre-token; the line feed put before it takes up the mark that the model adds."""
        return len(self.model.encode("\n" + pretoken)) - 2

    def count(self, text: str) -> int:
        """Tokens of a whole text, without special tokens."""
        if not text:
            return 0
        if not self.apart:
            return len(self.model.encode(text))
        found = list(map(self.__getitem__, text.split(" ")))
        if None in found:  # runs of spaces
            return sum(self[p[1:]] if p[0] == MARK and p[1:2] not in ("", MARK) else self._alone(p) for p in pretokens(text))
        return sum(found)


_STARTS = re.compile(f"(?<!{MARK})(?={MARK})|(?=\n)")
_INNER = re.compile(f"(?<={MARK})\x00(?={MARK})")


def pretokens(text: str) -> list[str]:
    """Runs of word marks, each with what follows up to the next run, and line feeds with what follows."""
    marked = MARK + text.replace(" ", MARK)
    if "\x00" in text:  # the separator used below
        return [p for p in _STARTS.split(marked) if p]
    marked = marked.replace(MARK, "\x00" + MARK).replace("\n", "\x00\n")
    if MARK + "\x00" + MARK in marked:
        marked = _INNER.sub("", marked)
    return [p for p in marked.split("\x00") if p]


def counter(path: str, frequent: dict[str, int] | None = None) -> PieceCounter:
    """The worker's counter of this model; kept between tasks."""
    if path not in _PIECES:
        _PIECES[path] = PieceCounter(path)
    _PIECES[path].frequent = frequent or {}
    return _PIECES[path]


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, most: int = FREQUENT) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a bounded sample of documents, chosen by the hash of doc_id."""
    ids = docs.select(F.xxhash64("doc_id").alias("h"))
    last = [r[0] for r in ids.orderBy("h").limit(sample_docs).agg(F.max("h")).collect()][0]
    if last is None:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                tally.update(p for p in (text or "").split(" ") if 0 < len(p) <= LONGEST)
        top = tally.most_common(most)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["w", "n"])

    counts = docs.where(F.xxhash64("doc_id") <= last).select(F.col("text").cast("string")).mapInArrow(run, "w string, n long")
    top = counts.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(most).collect()
    tier = PieceCounter(path)
    return {r["w"]: tier[r["w"]] for r in top}


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; a null text counts as empty.

    Repeated rows are counted each, null ids stay null, further columns are ignored.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, sent.value).count
        for b in batches:
            tokens = [count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
