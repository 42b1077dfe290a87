"""Retrieval and pairs of sets against loops, and what they shuffle."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import index as X
from tessera.operators import alike, joins, retrieval, scoring
from tessera.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


def shuffled(spark):
    """Bytes that the session's stages have written for others."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def best(queries, docs, k, boosted):
    """top_k by loops; rows of one key are one document, and of null are one that is not found."""
    bags, asked = {}, {}
    for table, rows in ((bags, docs), (asked, queries)):
        for key, tokens in rows:
            table.setdefault(key, Counter()).update(tokens or [])
    df = Counter(t for bag in bags.values() for t in bag)
    idf = {t: math.log((len(docs) + 1) / (n + 1)) + 1 for t, n in df.items()}
    out = []
    for q, words in asked.items():
        score = lambda bag: math.fsum(n * bag[t] * idf[t] * boosted.get(t, 1.0) for t, n in words.items() if t in bag) / math.sqrt(len(bag) + 1)  # noqa: B023, E731
        found = sorted((-round(s, 9), d) for d, bag in bags.items() if d is not None and (s := score(bag)) > 0)
        out += [(q, i + 1, d, round(-s, 6)) for i, (s, d) in enumerate(found[:k])]
    return sorted(out, key=repr)


def test_top_k_of_repeated_keys_and_copies(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: [f"w{int(rng.paretovariate(0.8))}" for _ in range(n)]
    docs = [(i, text(rng.randint(0, 30))) for i in range(600)] + [(rng.randint(0, 40), text(4)) for _ in range(60)] + [(None, text(5)) for _ in range(20)] + [(900, None)]
    docs += [(1000 + i, ["copy", "w1", "w2"]) for i in range(300)] + [(2000 + i, ["copy", "w2", "w1"]) for i in range(300)]
    rng.shuffle(docs)
    queries = [(i, text(rng.randint(1, 6)) + ["nowhere"]) for i in range(30)] + [(77, ["copy"]), (78, ["nowhere"]), (79, None), (None, ["copy", "w1"])]
    frames = [spark.createDataFrame(queries, "q long, t array<string>"), spark.createDataFrame(docs, "d long, t array<string>").repartition(5)]
    rows = lambda *f: sorted(((r["q"], r["rank"], r["d"], round(r["score"], 6)) for r in retrieval.top_k(*f, "q", "d", "t", 4, {"w2": 2.0}).collect()), key=repr)
    want = best(queries, docs, 4, {"w2": 2.0})
    monkeypatch.setattr(scoring, "CELLS", 200)  # a few documents at a time
    assert rows(*frames) == want and [r[2] for r in want if r[0] == 77] == [1000, 1001, 1002, 1003]
    assert [r["d"] for r in retrieval.top_k(frames[0].where("q = 77"), frames[1].withColumn("d", F.concat(F.lit("k"), "d")), "q", "d", "t", 2).orderBy("rank").collect()] == ["k1000", "k1001"]
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    assert rows(*frames) == want


def test_top_k_deals_no_terms(spark):
    chars = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    before = shuffled(spark)
    assert registry.QUERIES["retrieve_top_k"](spark, SF).count() > 0
    assert shuffled(spark) - before < chars / 2  # a row a query and document of the first of each task, and words of queries


def test_the_first_of_a_task_are_few():
    ids = pa.record_batch({"d": pa.array(range(5000))})
    first = scoring.Best(5, 2)
    for at in range(0, 5000, 500):
        first.add(ids.slice(at, 500), np.full((500, 2), [0.25, 0.0]))  # copies
    docs, queries = first.rows()
    assert docs.column("d").to_pylist() == [0, 1, 2, 3, 4] and queries.to_pylist() == [[0]] * 5
    close = scoring.Best(1, 1)
    close.add(ids.slice(0, 3), np.array([[0.5], [0.5 + 4.9999999e-10], [0.5 + 2e-9]]))
    assert close.rows()[0].column("d").to_pylist() == [2]
    close = scoring.Best(1, 1)
    close.add(ids.slice(0, 3), np.array([[0.5], [0.5 + 5e-10], [0.5 + 1e-10]]))  # which of the first two is larger hangs on the last place
    assert close.rows()[0].column("d").to_pylist() == [0, 1]


def test_index_deals_no_postings_and_reads_all_or_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    text = lambda n: [f"w{int(rng.paretovariate(0.7))}" for _ in range(n)]
    rows = [(i, text(rng.randint(1, 60))) for i in range(2000)] + [(5, ["w1", "again"]), (None, ["w2"]), (None, ["w2", "w3"]), (3000, []), (3001, None)]
    docs = spark.createDataFrame(rows, "d long, t array<string>")
    monkeypatch.setattr(scoring, "SEGMENT", 5000)
    monkeypatch.setattr(X, "BLOCK", 16)
    before = shuffled(spark)
    X.add_source(docs.where("d <= 5"), "d", "t", str(tmp_path), "a")
    X.add_source(docs.where("d > 5 OR d IS NULL"), "d", "t", str(tmp_path), "b")
    index = X.Index(spark, str(tmp_path), ["a", "b"])
    assert shuffled(spark) - before < 8 * sum(len(t or []) for _, t in rows) / 2  # of 40,000 tokens and more
    blocks = index.blocks.collect()
    assert len({(b["source"], b["token"], b["level"], b["chunk"]) for b in blocks}) == len(blocks) and max(b["size"] for b in blocks) == 16
    assert all(b["size"] == len(b["entries"]) and b["best"] == max(e["impact"] for e in b["entries"]) for b in blocks)
    bags = {}
    for key, tokens in rows:
        bags.setdefault(key, Counter()).update(tokens or [])
    impacts = {(b["token"], e["key"]): e["impact"] for b in blocks for e in b["entries"]}
    assert impacts == {(t, d): n / math.sqrt(len(bag) + 1) for d, bag in bags.items() for t, n in bag.items()}
    queries = [(i, text(3)) for i in range(40)] + [(50, ["again", "nowhere"])]
    weights = index.weights(spark.createDataFrame(queries, "q long, t array<string>"), "q", "t", {"w2": 2.0})
    found = lambda *needed: sorted((r["query"], r["rank"], r["key"], round(r["score"], 6)) for r in index.top_k(weights, 3, *needed).collect())
    want = sorted(best(queries, rows, 3, {"w2": 2.0}))
    assert not index._meets_all(weights) and found() == want
    monkeypatch.setattr(X, "MET", 1)
    assert index._meets_all(weights) and found() == want == found(index.needed(weights, 3))


def test_equal_keys_of_two_sources(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "MET", 0)
    docs = spark.createDataFrame([(i, ["a", f"w{i % 2}"]) for i in range(8)], "d long, t array<string>")
    for source in ("s", "r"):
        X.add_source(docs, "d", "t", str(tmp_path), source)
    index = X.Index(spark, str(tmp_path), ["s", "r"])
    weights = index.weights(spark.createDataFrame([(1, ["a"])], "q long, t array<string>"), "q", "t")
    assert index._meets_all(weights)
    assert [(r["source"], r["key"]) for r in index.top_k(weights, 3).orderBy("rank").collect()] == [("r", 0), ("s", 0), ("r", 1)]


def test_examples_go_to_documents(spark):
    plan = registry.QUERIES["example_blocks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and "MapInArrow" not in plan  # what was found is a table, and documents aren't dealt


def test_pairs_of_blocks(spark, monkeypatch):
    rng = random.Random(11)
    base = [rng.sample(range(300), rng.choice([1, 3, 40, 120])) for _ in range(20)]
    near = lambda x: [t for t in x if rng.random() > 0.05] + rng.sample(range(300, 600), rng.randint(0, max(1, len(x) // 15)))
    sets = [(rng.choice("oooopq"), i, [f"w{t}" for t in near(rng.choice(base))]) for i in range(260)] + [(f"s{i // 2}", 1000 + i, ["a", "b", f"c{i % 4}"]) for i in range(60)]
    rows = spark.createDataFrame(sets, "o string, k int, t array<string>")
    like = lambda x, y, shares: len(x & y) >= (shares[1] if min(len(x), len(y)) >= 100 else shares[0]) * len(x | y) or (shares[2] and len(x & y) >= shares[2] * min(len(x), len(y)))
    by_loops = lambda *shares: sorted((o, a, b) for o, a, x in sets for p, b, y in sets if o == p and a < b and x and y and like({*x}, {*y}, shares))
    found = lambda *a: sorted(map(tuple, retrieval.similar_pairs(rows, "o", "k", "t", *a).collect()))
    monkeypatch.setattr(retrieval, "SETS", 30)  # o has several blocks
    monkeypatch.setattr(retrieval, "TOGETHER", 40)
    assert found(0.88, 100, 0.93, 0.85) == by_loops(0.88, 0.93, 0.85) and found(0.5) == by_loops(0.5, 0.5, None)


def test_alike_sets_of_a_task_a_few_at_a_time(monkeypatch):
    rng = random.Random(12)
    sets = [rng.sample(range(60), rng.randint(1, 40)) for _ in range(150)]
    sets += [[t for t in x if rng.random() > 0.05] + [100 + i] for i, x in enumerate(sets)]
    ids, sides = np.arange(len(sets)) * 7, np.arange(len(sets)) % 2
    got = lambda apart: sorted(zip(*(x.tolist() for x in alike.alike(ids, sides, pa.array(sets, pa.list_(pa.int64())), apart, 0.7, None, None, 0.9)), strict=True))
    like = lambda x, y: len(x & y) >= 0.7 * len(x | y) or len(x & y) >= 0.9 * min(len(x), len(y))
    want = sorted((7 * i, 7 * j) for i, x in enumerate(sets) for j, y in enumerate(sets) if (len(x), i) < (len(y), j) and like({*x}, {*y}))
    assert got(False) == want and len(want) > 150
    monkeypatch.setattr(alike, "MEETINGS", 50)
    assert got(False) == want and got(True) == [(p, q) for p, q in want if p % 2 != q % 2]


def test_alike_segments_deals_sets_only(spark):
    before = shuffled(spark)
    assert registry.QUERIES["alike_segments"](spark, SF).count() >= 0
    tokens = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+")))).count()
    assert shuffled(spark) - before < 3 * 8 * tokens  # eight bytes a token, dealt for equal sets and for pairs
