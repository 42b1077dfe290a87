"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters are words (lexicon) and word beginnings (patterns) that mark toxic rows among the labelled training
rows.  The label model estimates each voter's accuracy by expectation maximisation over the votes, and the
correlations of voters given the label, by which a vote that others repeat counts less.  A logistic classifier
over the voters and further marks is trained on the posterior labels and scores every document.

Marks are counted over all labelled training rows.  Label model and classifier are fitted to a bounded sample of these
rows: POSITIVES and NEGATIVES of each label at most, by the hash of id and text.  Every document is scored, as a whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc_mod, materialize, small_batches

#: Labelled rows of the sample, by label.
POSITIVES, NEGATIVES = 2_000, 6_000
#: Letters of a word beginning; voters, and marks that the classifier sees; times that a mark's rate among label 1
#: is at least that among label 0.
SHORTEST, LONGEST_START = 4, 7
VOTERS, MARKS, RATIO = 256, 1_024, 20
CACHED, LONGEST = 500_000, 64
#: Marks that a task counts before it hands its counts on; chunks of text whose marks it remembers.
TALLIED = 200_000
THRESHOLD = 0.7

_LETTERS = re.compile(r"[^\W\d_]+").findall


def marks_of(chunk: str) -> set[str]:
    """Words of a chunk of text without white space, in lower case, and their beginnings (ending in '-')."""
    out = set()
    for word in _LETTERS(chunk.lower()):
        out.add(word[:LONGEST])
        out.update(word[:k] + "-" for k in range(SHORTEST, min(LONGEST_START, len(word)) + 1))
    return out


class Spotter(dict):
    """Positions of known marks by chunk of text; kept until the cache is full."""

    def __init__(self, marks: list[str]):
        super().__init__()
        self.place = {m: i for i, m in enumerate(marks)}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = tuple(self.place[m] for m in marks_of(chunk) if m in self.place)
        if len(chunk) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = found
        return found

    def of(self, text: str | None) -> list[int]:
        return sorted({i for c in set((text or "").split()) for i in self[c]})


class LabelModel:
    """Voters that fire or abstain, given a hidden label: P(fires | label) of each, and their correlations."""

    def __init__(self, prior: float):
        self.prior = min(0.5, max(1e-3, prior))

    def fit(self, votes: np.ndarray, start: np.ndarray, times: np.ndarray, rounds: int = 15) -> LabelModel:
        """votes: rows by voters, 0 or 1; start: first guesses of the rows' probabilities of label 1; times: how often a row occurs."""
        p = start.astype(float)
        for _ in range(rounds):
            one, none = times * p, times * (1 - p)
            self.fires = np.array([(votes.T @ one + 0.1) / (one.sum() + 1), (votes.T @ none + 0.01) / (none.sum() + 1)])
            self.correlations = self._correlations(votes, p, times)
            p = self.posterior(votes)
        return self

    def _correlations(self, votes: np.ndarray, p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Correlations of what the label leaves unexplained."""
        rest = votes - (np.outer(p, self.fires[0]) + np.outer(1 - p, self.fires[1]))
        rest *= np.sqrt(times)[:, None]
        rest /= np.sqrt((rest**2).sum(axis=0) + 1e-9)
        out = np.maximum(0, rest.T @ rest)
        np.fill_diagonal(out, 0)
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(label 1) of each row; a vote counts less the more correlated votes fired with it.

        A voter that abstains says nothing.
        """
        shared = 1 + votes @ self.correlations
        z = np.log(self.prior / (1 - self.prior)) + (votes / shared) @ np.log(self.fires[0] / self.fires[1])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-2, rounds: int = 12) -> np.ndarray:
    """Logistic regression on probabilities y by Newton steps; x has a last column of ones, for the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = np.diag(penalty)
        for at in range(0, len(x), 1024):  # in blocks, so that no second matrix of this size is held
            part = x[at : at + 1024].astype(float)
            h += (part * (weights * np.maximum(p * (1 - p), 1e-6))[at : at + 1024, None]).T @ part
        step = np.linalg.solve(h, x.T @ (weights * (p - y)) + penalty * w)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


def _labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(text, y, h) of all labelled training rows, and the share of label 1 among all training labels."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(crc_mod("doc_id", 3) != 1).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("y"))
    rate = known.agg(F.avg("y")).first()[0] or 0.0
    # merged at every size: labels may grow with the documents, so they are never broadcast
    rows = docs.where(crc_mod("doc_id", 3) != 1).join(known.hint("merge"), docs["doc_id"] == known["_id"])
    return rows.select(F.col("text").cast("string").alias("text"), "y", F.xxhash64("_id", "text").alias("h")), rate


def _sample(rows: DataFrame) -> DataFrame:
    """(text, y) of POSITIVES and NEGATIVES different rows at most, those of the least hashes of id and text."""
    picked = [rows.where(f"y = {y}").select("y", "h").distinct().orderBy("h").limit(n) for y, n in ((1, POSITIVES), (0, NEGATIVES))]
    return rows.join(F.broadcast(picked[0].union(picked[1])), ["y", "h"]).dropDuplicates(["y", "h"]).select("text", "y")


def pick_marks(rows: DataFrame, most: int = MARKS) -> list[str]:
    """Marks of label 1 in the rows (text, y), the most telling first, by the likelihood-ratio statistic G2.

    Every row counts.  A mark's G2 must be more than chance gives among as many candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
        known: dict[str, set[str]] = {}

        def told() -> pa.RecordBatch:
            names = list(tally[1].keys() | tally[0].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([tally[y][m] for m in names], pa.int64()) for y in (1, 0)]], names=["mark", "one", "none"])
            for t in tally.values():
                t.clear()
            return out

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = set()
                for c in set((text or "").split()):
                    of = known.get(c)
                    if of is None:
                        of = marks_of(c)
                        if len(c) <= LONGEST and len(known) < TALLIED:
                            known[c] = of
                    found |= of
                tally[y].update(found)
                if len(tally[0]) + len(tally[1]) >= TALLIED:
                    yield told()
        yield told()

    tallies = rows.select("text", "y").mapInArrow(run, "mark string, one long, none long").groupBy("mark").agg(F.sum("one").alias("one"), F.sum("none").alias("none"))
    counts = materialize(tallies.where(F.col("one") >= 3), "toxicity-marks")
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones, nones = float(size.get(1, 0)), float(size.get(0, 0))
    if not ones or not nones:
        return []
    all_, n = F.col("one") + F.col("none"), ones + nones
    term = lambda c, total: F.when(c > 0, c * F.log(c * n / (all_ * total))).otherwise(0.0)
    g2 = 2 * (term(F.col("one"), F.lit(ones)) + term(F.col("none"), F.lit(nones)))
    candidates = counts.count()
    telling = counts.withColumn("g2", g2).where((F.col("one") / ones > RATIO * F.col("none") / nones) & (F.col("g2") >= 2 * np.log(max(2, candidates))))
    rows = telling.orderBy(F.desc("g2"), "mark").limit(2 * most).collect()
    return [r["mark"] for r in rows if not _owed_to_longer(r, rows)][:most]


def _owed_to_longer(r, rows) -> bool:
    """Whether a word beginning that label 0 has too owes its rows of label 1 to a longer mark that label 0 has less of."""
    if not r["none"] or not r["mark"].endswith("-"):
        return False
    stem = r["mark"][:-1]
    return any(o["mark"].startswith(stem) and o["mark"] != r["mark"] and o["one"] >= 0.9 * r["one"] and o["none"] < r["none"] for o in rows)


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, LabelModel | None]:
    """Marks, coefficients of the classifier (the intercept last) and the label model."""
    small_batches(docs.sparkSession)
    rows, rate = _labelled(docs.select("doc_id", "text"), labels)
    rows = materialize(rows, "toxicity-labelled")  # read several times; the documents once
    marks = pick_marks(rows)
    if not marks:
        return [], np.array([-5.0]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter(marks)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([spotter.of(t) for t in b.column(0).to_pylist()], pa.list_(pa.int32())), b.column(1)], names=["found", "y"])

    rows = _sample(rows).mapInArrow(run, "found array<int>, y int").groupBy("found", "y").agg(F.count("*").alias("n")).collect()  # bounded by the sample
    rows.sort(key=lambda r: (r["y"], r["found"]))
    times = np.array([r["n"] for r in rows], float)  # rows of the same marks and label are held once, with their number
    x = np.zeros((len(rows), len(marks) + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, r["found"]] = 1
    x[:, -1] = 1
    y = np.array([r["y"] for r in rows])
    votes = x[:, : min(VOTERS, len(marks))]
    votes = np.hstack([votes, votes.sum(axis=1, keepdims=True) == 0])  # the last voter: no other has fired
    share = float(np.average(y, weights=times))
    model = LabelModel(share).fit(votes, np.where(votes[:, -1] == 0, 0.9, 0.02), times)
    posterior = model.posterior(votes)
    weights = times * np.where(y == 1, rate / max(1e-9, share), (1 - rate) / max(1e-9, 1 - share))
    return marks, fit_linear(x, posterior, weights), model


def _scored(packed: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Rows of packed (doc, a struct that has doc_id and text) with score and predicted."""
    marks, w, _ = train(packed.select("doc.doc_id", "doc.text"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter(marks)
        for b in batches:
            texts = b.column(0).field("text").to_pylist() if b.num_rows else []
            z = np.array([w[-1] + w[spotter.of(t)].sum() for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())], names=["doc", "score"])

    small_batches(packed.sparkSession)
    schema = StructType([packed.schema["doc"], StructField("score", DoubleType())])
    return packed.select("doc").mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text; further columns are ignored).

    labels has doc_id and toxic; only rows whose crc32(doc_id as text) mod 3 is not 1 are learnt from, and where an
    id has several labels the largest counts.  Without labels of both kinds, or without telling marks, every
    score is that of an empty text.  Null texts count as empty; a null doc_id is not held out; repeated rows are
    scored each; an empty table gives an empty result.
    """
    doc = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).alias("doc")
    held_out = F.coalesce(crc_mod("doc.doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return _scored(docs.select(doc), labels, threshold).select("doc.doc_id", held_out, "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted toxic, each judged by its own text, with all their columns."""
    return _scored(docs.select(F.struct(*docs.columns).alias("doc")), labels, threshold).where("predicted = 0").select("doc.*")
