"""Mixing against a version in plain Python, on odd tables, and with a source of a third of all rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from tessera.llm import mixture

SCHEMA = "doc_id long, text string, source string, size int, target int, rows int, place int, named boolean"
EXTRA = (1, 2, 3, 4, True)


def brute(rows, weights=(3, 1, 2), percent=150, epochs=2, seed=13):
    docs = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s, hashlib.md5(f"{seed}:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:16]) for i, t, s in rows]
    size = Counter()
    for _, n, s, _ in docs:
        size[s] += n
    sources = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target = {s: Fraction(0) for s in sources}
    free, left = set(sources), Fraction(percent * sum(size.values()), 100)
    while free:  # deal what is left by weight; who is above its cap keeps the cap, and the rest is dealt again
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] >= epochs * size[s]}
        target |= {s: Fraction(epochs * size[s]) if s in above else level * weight[s] for s in free}
        if not above:
            break
        free, left = free - above, left - sum(epochs * size[s] for s in above)
    taken, by_source = {}, defaultdict(Counter)
    for doc_id, n, s, digest in docs:
        by_source[s][digest, doc_id is None, doc_id or 0, n] += 1
    for s, units in by_source.items():
        whole, rest = divmod(int(target[s]), size[s]) if size[s] else (0, 0)
        for unit in sorted(units):
            some = min(unit[3] * units[unit], rest)
            taken[s, unit] = whole * unit[3] + some // units[unit]
            rest -= some
    return sorted(((-1 if i is None else i), n, size[s], round(float(target[s]), 6), taken[s, (d, i is None, i or 0, n)]) for i, n, s, d in docs)


def rows_of(result):
    return sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in result.collect())


def test_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = mixture.mixture(docs)
    assert rows_of(got) == brute([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    by_source = got.groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    assert all(0 <= r["target"] - r["sum(taken)"] < 2 for r in by_source)
    assert rows_of(mixture.mixture(docs.repartition(7))) == rows_of(got)


@pytest.mark.parametrize("weights, percent, epochs", [((3, 1, 2), 150, 2), ((1,), 20, 1), ((5, 1), 1000, 3), ((2, 1, 1, 9), 260, 4)])
def test_odd_rows(spark, weights, percent, epochs):
    rng = random.Random(percent)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["b", "a", "é", "", None, "B"]), *EXTRA) for i in range(300)]
    rows += [(7, "the same row", "hot", *EXTRA)] * 200 + [(None, "no id here", "hot", *EXTRA)] * 50 + [(None, None, "null", *EXTRA), (9, "", None, *EXTRA), (10, "x " * 20_000, "long", *EXTRA)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = mixture.mixture(docs, weights, percent, epochs)
    assert rows_of(got) == brute([r[:3] for r in rows], weights, percent, epochs)
    assert all(r["taken"] <= epochs * r["size"] and r["part"] <= r["size"] for r in got.collect())


def test_empty(spark):
    assert mixture.mixture(spark.createDataFrame([], SCHEMA)).collect() == []
    assert rows_of(mixture.mixture(spark.createDataFrame([(1, None, None, *EXTRA)], SCHEMA))) == [(1, 0, 0, 0.0, 0)]
