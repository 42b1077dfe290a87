"""The toxicity model against plain loops; very long texts and clashing columns for operators on texts and vectors."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from tessera.llm import bpe, collocation, divergence, linededup, lm, mixture, permutation, quality, simhash, tokencount, toxicity

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_label_model(votes, start, times, prior, rounds=15):
    """P(label 1) of each row, by loops over rows and voters."""
    n, v = len(votes), len(votes[0])
    p = list(start)
    for _ in range(rounds):
        one, none = sum(t * q for t, q in zip(times, p, strict=True)), sum(t * (1 - q) for t, q in zip(times, p, strict=True))
        fires = [[(sum(times[i] * p[i] * votes[i][j] for i in range(n)) + 0.1) / (one + 1) for j in range(v)], [(sum(times[i] * (1 - p[i]) * votes[i][j] for i in range(n)) + 0.01) / (none + 1) for j in range(v)]]
        rest = [[(votes[i][j] - p[i] * fires[0][j] - (1 - p[i]) * fires[1][j]) * math.sqrt(times[i]) for j in range(v)] for i in range(n)]
        size = [math.sqrt(sum(rest[i][j] ** 2 for i in range(n)) + 1e-9) for j in range(v)]
        alike = [[0.0 if a == b else max(0.0, sum(rest[i][a] * rest[i][b] for i in range(n)) / size[a] / size[b]) for b in range(v)] for a in range(v)]
        for i in range(n):
            z = math.log(prior / (1 - prior))
            for j in range(v):
                if votes[i][j]:
                    z += math.log(fires[0][j] / fires[1][j]) / (1 + sum(alike[k][j] for k in range(v) if votes[i][k]))
            p[i] = 1 / (1 + math.exp(-min(40, max(-40, z))))
    return p


def test_label_model_against_loops():
    rng = random.Random(2)
    votes = [[int(rng.random() < (0.7 if i % 3 == 0 else 0.1)) for _ in range(5)] for i in range(60)]
    for row in votes:
        row[4] = row[3] if rng.random() < 0.9 else row[4]  # two voters that copy each other
    start, times = [0.9 if sum(r) > 1 else 0.02 for r in votes], [1.0 + i % 4 for i in range(60)]
    model = toxicity.LabelModel(0.2).fit(np.array(votes, float), np.array(start), np.array(times))
    want = plain_label_model(votes, start, times, 0.2)
    assert model.posterior(np.array(votes, float)) == pytest.approx(want, abs=1e-9)
    assert model.correlations[3, 4] == model.correlations.max() > 0 and max(want) > 0.9 and min(want) == pytest.approx(0.2)  # a row without a vote has the prior


def test_linear_classifier_against_loops():
    rng = random.Random(4)
    x = [[float(rng.random() < 0.4) for _ in range(4)] + [1.0] for _ in range(80)]
    y, weights = [min(1, max(0, 0.1 + 0.6 * r[0] + 0.2 * r[1] * rng.random())) for r in x], [rng.choice([0.5, 1.0, 2.0]) for _ in x]
    w = toxicity.fit_linear(np.array(x), np.array(y), np.array(weights), rounds=60)
    penalty = [1e-2] * 4 + [1e-6]
    slope = [sum(k * (1 / (1 + math.exp(-sum(a * b for a, b in zip(r, w, strict=True)))) - t) * r[j] for r, t, k in zip(x, y, weights, strict=True)) + penalty[j] * w[j] for j in range(5)]
    assert slope == pytest.approx([0.0] * 5, abs=1e-5)  # the least loss, by its gradient


def test_marks_and_scores_against_loops(spark):
    """Marks by counters over all rows, scores by adding up coefficients word by word."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice(["grünt", "plain", "words", "somewhere", "andere"]) + rng.choice(["", "s", "!"]) for _ in range(12)]
        rows.append((i, " ".join(words + ([rng.choice(["vilest", "Vilely", "grob"])] if toxic and rng.random() < 0.9 else [])), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    train = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    tally, size = {0: Counter(), 1: Counter()}, Counter(y for _, y in train)
    for t, y in train:
        tally[y].update({m for c in t.split() for m in toxicity.marks_of(c)})
    n, found = sum(size.values()), []
    candidates = sum(c >= 3 for c in tally[1].values())
    for m, one in tally[1].items():
        none = tally[0][m]
        term = lambda c, s, all_: c * math.log(c * n / (all_ * s)) if c else 0.0
        g2 = 2 * (term(one, size[1], one + none) + term(none, size[0], one + none))
        if one >= 3 and one / size[1] > toxicity.RATIO * none / size[0] and g2 >= 2 * math.log(max(2, candidates)):
            found.append((-round(g2, 9), m))
    marks, w, _ = toxicity.train(docs, labels)
    assert set(marks) == {m for _, m in found} and {"vile-", "grob"} <= set(marks)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    for i, t, y in rows:
        z = w[-1] + sum(w[marks.index(m)] for m in {m for c in t.split() for m in toxicity.marks_of(c)} if m in marks)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z))) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
        assert got[i]["predicted"] <= y


@pytest.fixture(scope="module")
def long(spark):
    """Two texts of more than a million letters, one of them twice, between short ones."""
    rng = random.Random(1)
    many = " ".join(rng.choice(["alpha", "Beta", "gamma,", "δέλτα", "w7"]) + str(rng.randint(0, 40)) for _ in range(150_000))
    lines = "\n".join(f"line {i} " + "word " * 12 for i in range(15_000))
    texts = [many, lines, "short text here", lines, "y" * 1_200_000]
    return texts, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n int").repartition(3)


def test_long_texts(spark, long):
    texts, docs = long
    words = [t.encode().lower().split() for t in texts]
    got = {r["doc_id"]: r for r in quality.base_statistics(docs).collect()}
    assert [got[i]["n_words"] for i in range(5)] == [len(w) for w in words]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    for i, w in enumerate(words):
        bits, shingles = [0] * 64, [b" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        for h, c in Counter(shingles).items():
            h = xxhash.xxh64_intdigest(h, 42)
            for b in range(64):
                bits[b] += c * (h >> b & 1)
        assert got[i]["fingerprint"] == f"{sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles)):016x}"
    assert got[3]["component_id"] == 1
    got = {r["doc_id"]: r for r in linededup.line_dedup(docs).collect()}
    assert got[1]["lines_removed"] == 0 and got[3]["lines_removed"] == 15_000 and got[3]["text"] == ""
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(docs, PIECES).collect()} == {i: len(model.encode(t)) for i, t in enumerate(texts)}
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    for r in bpe.encode_digests(docs, BYTE_BPE).collect():
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert {r["doc_id"]: r["n_tokens"] for r in lm.katz_scores(docs).collect()} == {i: len(w) + 1 for i, w in enumerate(words)}
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 5
    assert {r["doc_id"]: r["size"] for r in mixture.mixture(docs).collect()} == {i: len(w) for i, w in enumerate(words)}
    assert divergence.divergence(docs, 1).count() == 0 and collocation.collocations(docs, least=20_000).where("phrase = 'word word word word'").count() == 1


def test_search_with_clashing_columns(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    rows = [(i, x.tolist(), "a", 1, [2], 0.5) for i, x in enumerate(v)]
    vectors = spark.createDataFrame([*rows, rows[5], rows[5]], "vec_id long, embedding array<double>, v string, rank int, ids array<int>, score double").repartition(4)
    got = defaultdict(list)
    for r in permutation.search(vectors, k=5, every=20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 300, 20):
        want = sorted((-float(v[i] @ v[q]), i) for i in range(300) if i != q)[:5]
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in want]


def test_empty_vectors(spark):
    assert permutation.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
