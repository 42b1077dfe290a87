"""Collocations against a version in plain Python, with small and odd tables and a filter that lets nearly all through."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import blocks, collocation

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, a int, rank int, w array<int>"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, longest=4, least=30, top=2000, covered=80):
    count, every = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            every[lang] += len(words)
            for k in range(1, longest + 1):
                count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        parts = lambda p: {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}
        gone = {q for p, a in found.items() for q in parts(p) if 100 * a >= covered * found[q]}
        ranked = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, every[lang], -score))
    return sorted(out)


def rows_of(result):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in result.collect())


def test_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert rows_of(collocation.collocations(docs)) == brute(rows)
    assert rows_of(collocation.collocations(docs, 3, 5, 40, 60)) == brute(rows, 3, 5, 40, 60)


@pytest.mark.parametrize("bits", [64, 1 << 16])
@pytest.mark.parametrize("block", [1, 1 << 20])
def test_odd_rows(spark, monkeypatch, block, bits):
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(collocation, "LEAST_BITS", bits)
    monkeypatch.setattr(collocation, "MOST_BITS", bits)
    texts = [None, "", " . ", "a a a a a a", "New York, new york city new york city!", "É é\xa0x\x00 y. é é\x1fx y", "x" * 6000 + " a b", "p q r s t u " * 500, "new\ryork", "a\tb  c"]
    rows = [(i, t, lang, "p", 1, 2, 3, [4]) for i, t in enumerate(texts * 2) for lang in ("en", "und", None, "de", "de")]
    rows += [(None, "hot rows stay whole", "en", "p", 1, 2, 3, [4])] * 150
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(collocation.collocations(docs, 4, 3)) == brute([(r[1], r[2]) for r in rows], 4, 3)


def test_empty(spark):
    assert collocation.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocation.collocations(spark.createDataFrame([(1, "a b", "en", "p", 1, 2, 3, [4])], SCHEMA)).collect() == []


def test_filter_lets_frequent_phrases_through(spark):
    phrases = [f"w{i} é{i % 7}" for i in range(3000)]
    bits = collocation.frequent_filter(spark.createDataFrame([("en", p) for p in phrases], "lang string, phrase string").repartition(3))
    hashes = lambda lang, words: collocation._longer(collocation._first(collocation._word_hashes(lang), collocation._word_hashes(words[0])), collocation._word_hashes(words[1]))
    import pyarrow as pa

    columns = [pa.array([p.split(" ")[j].encode() for p in phrases]) for j in (0, 1)]
    assert collocation._member(bits, hashes(pa.array([b"en"] * 3000), columns)).all()
    assert np.mean(collocation._member(bits, hashes(pa.array([b"de"] * 3000), columns))) < 0.05
