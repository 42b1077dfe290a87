"""The divergence audit against a version in plain Python, and on odd tables."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, p array<int>, rank int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=10, terms=10):
    docs = [(lower(t or ""), lang or "", source or "") for t, lang, source in rows]
    seen, count = defaultdict(Counter), defaultdict(Counter)
    for text, lang, _ in docs:
        seen[lang].update(set(TERM.findall(text)))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in seen.items()}
    for text, lang, source in docs:
        count[lang, source].update(t for t in TERM.findall(text) if t in kept[lang])
    out = set()
    for lang, source in count:
        sources, words = sorted(s for g, s in count if g == lang), kept[lang]
        own = {s: count[lang, s] for s in sources}
        whole = sum(own.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(words))  # noqa: E731, B023
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        pairs = [(-sum(apart(share(own[source], t), share(own[s], t)) for t in words), s.encode()) for s in sources if s != source]
        used = [(-apart(share(own[source], t), share(whole, t)), t.encode()) for t in words if own[source][t] and share(own[source], t) > share(whole, t)]
        for part, ranked in (("pair", sorted(pairs)), ("term", sorted(used)[:terms])):
            out |= {(lang, source, part, item.decode(), -v, i) for i, (v, item) in enumerate(ranked, 1)}
    return out


def rows_of(result):
    return [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in result.collect()]


def test_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = rows_of(divergence.divergence(docs))
    assert len(got) == len(set(got)) and set(got) == brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()])


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    texts = [None, "", "...", "Ab ab\x00AB é日本_é", "é É ab", "a" * 5000, "w1w w" * 3000, "ab ab"]
    rows = [(i, t, lang, source, "x", 1, [1], 2) for i, t in enumerate(texts * 3) for lang, source in (("en", "s"), ("en", None), (None, None), ("de", "t"))]
    rows += [(None, "ab hot", "en", "hot", "x", 1, [1], 2)] * 200 + [(1, None, "fr", "u", "x", 1, [1], 2), (1, "7", "fr", "v", "x", 1, [1], 2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = rows_of(divergence.divergence(docs, 2, 3))
    want = brute([(r[1], r[2], r[3]) for r in rows], 2, 3)
    assert len(got) == len(set(got)) and set(got) == want
    assert ("fr", "u", "pair", "v", 0, 1) in want


def test_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_are_exact(spark):
    big = spark.createDataFrame([(4 * 10**15, 9 * 10**15, 3)], "n long, whole long, terms long")
    assert big.select(divergence._share(F.col("n"), F.col("whole"), F.col("terms"))).first()[0] == 1 + 10**9 * (4 * 10**15 + 2) // (9 * 10**15 + 6)
