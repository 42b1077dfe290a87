"""Queries against their SQL on small tables of rows that the smallest tables lack."""

import glob
import os
import random
import time
import tracemalloc

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.functions import ordered as O
from tessera.functions import scan
from tessera.functions.damage import damaged
from tessera.llm import lm, queries
from tessera.operators import index as X
from tessera.operators import joins, retrieval
from tessera.operators import layout as L
from tessera.operators.folds import ordered_fold
from tessera.sources import files
from tessera.plans import registry

registry.load()
SF, SF_001 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows_of(frame):
    return sorted(map(repr, map(tuple, frame.select(*sorted(frame.columns)).collect())))


def same_as_sql(spark, folder, name):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = c.sql(registry.ORACLE_SQL[name])
    columns = sorted(want.columns)
    rows = sorted(repr(tuple(r[want.columns.index(x)] for x in columns)) for r in want.fetchall())
    assert rows and rows_of(registry.QUERIES[name](spark, str(folder))) == rows


def test_choices_end_at_a_line_end(spark, tmp_path):
    duckdb.sql("SELECT 4 * i AS doc_id, CASE i % 3 WHEN 0 THEN repeat('a', 199) || chr(10) || 'b' WHEN 1 THEN chr(10) || ' a ' || chr(10) ELSE 'c' END AS text, 'en' AS lang, 's' AS source, 3 AS n_chars FROM range(64) t(i)").write_parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, tmp_path, "split_choices")


def test_a_part_without_a_box(spark, tmp_path):
    duckdb.sql(f"SELECT * FROM '{SF_001}/lineitem.parquet' WHERE l_orderkey // 8 IN (1643, 1644)").write_parquet(f"{tmp_path}/lineitem.parquet")
    same_as_sql(spark, tmp_path, "overlapping_owners")
    parts = spark.createDataFrame([(1, 0, 0, 0, 10, 10, 5), (1, 1, None, None, None, None, 5), (1, 2, 0, 0, 10, 10, 5)], "page long, part long, x0 long, y0 long, x1 long, y1 long, printed long")
    parts = parts.selectExpr("*", "1 AS chars", "CAST(NULL AS long) AS answer", "CAST(NULL AS long) AS question", "part AS place")
    merged = lambda **k: [r["merged"] for r in L.merged_owners(parts, **k).orderBy("part").collect()]
    assert merged() == [0, 1, 2] and merged(boxless=True) == [0, 0, 0]


def test_stray_commands_of_a_text_of_many(spark):
    text = "\\alpha \\beta " * 3000 + "\n" + "\n".join(f"\\frac{i} \\_x" for i in range(3000))
    began = time.monotonic()
    hits = spark.createDataFrame([(text,)], "t string").select(scan.stray_commands(F.col("t"))).first()[0]
    assert time.monotonic() - began < 60
    heads = lambda match: [(i + 2, match, f"\\frac{i} \\_x") for i in range(3000)]
    first = text.split("\n")[0][: scan.LINE]
    assert [tuple(h) for h in hits] == [(1, "\\alpha", first), (1, "\\beta", first), *heads("\\frac"), *heads("\\_")]


def test_damage_computes_its_text_once(spark):
    plan = spark.range(1).select(damaged(F.expr("replace('a', 'b', cast(id as string))")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("replace(") == 1


def test_spellings_are_counted_before_they_are_collated(spark):
    plan = registry.QUERIES["collated_matches"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [w#" in plan


def test_values_of_equal_expressions_are_held(spark):
    O.arithmetic.cache_clear()
    assert [O.chain_faults(x) for x in ["1 + 2 = 4", "1 + 2 = 4", "03 = 3", "3\x1c = 3"]] == [["E_ARITH_MISMATCH"]] * 2 + [[]] * 2
    assert O.arithmetic.cache_info().hits >= 2
    assert [r[0] for r in spark.createDataFrame([("1 = 2\n1 < 3 < 2",), (None,), ("1 = 2",), ("1 = 2",)], "t string").select(O.arithmetic_issues("t")).collect()] == [["E_ARITH_MISMATCH", "E_INEQ_CHAIN_MISMATCH"], [], ["E_ARITH_MISMATCH"], ["E_ARITH_MISMATCH"]]


def test_documents_meet_the_tokens_of_queries(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, ["a"] * (i % 3) + ["b", f"w{i % 5}"]) for i in range(40)], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["a", "w1"]), (2, ["b", "w2"])], "item_id long, tokens array<string>")
    X.add_source(docs, "doc_id", "tokens", str(tmp_path), "s")
    index = X.Index(spark, str(tmp_path), ["s"])
    weights = index.weights(asked, "item_id", "tokens")
    met = index._entries(weights.join(index.blocks.select("source", "token", "level", "chunk"), "token")).collect()
    assert len(met) == 40 and {r["key"]: sorted(r["queries"]) for r in met}[1] == [1, 2]  # a row a document, not one a query
    rows = lambda frame: sorted((r[0], r["rank"], r[-2], round(r["score"], 8)) for r in frame.collect())
    both = lambda: (rows(retrieval.top_k(asked, docs, "item_id", "doc_id", "tokens", 5)), rows(index.top_k(weights, 5)))
    plan = retrieval.top_k(asked, docs, "item_id", "doc_id", "tokens", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    small = both()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert both() == small and small[0] == small[1] and len(small[0]) == 10


def test_katz_query_takes_three_words(monkeypatch):
    asked = {}
    monkeypatch.setattr(queries, "table", lambda *a: None)
    monkeypatch.setattr(queries.lm, "katz_scores", lambda docs, order=lm.ORDER: asked.update(order=order))
    queries.op10_katz(None, "")
    assert asked == {"order": 3}


def test_a_fold_reads_its_columns_only(spark):
    rows = spark.createDataFrame([(1, i, i * 2, "x") for i in range(4)], "k long, at long, n long, other string")
    step = lambda state, row: ((state or 0) + row["n"], ((state or 0) + row["n"] if list(row) == ["k", "n"] else None,))
    got = ordered_fold(rows, ["k"], ["at"], step, "total long", ["n"]).orderBy("at").collect()
    assert [(r["other"], r["total"]) for r in got] == [("x", 0), ("x", 2), ("x", 6), ("x", 12)]


def test_pairs_of_longer_sets_and_of_copies(spark):
    rng = random.Random(5)
    base = [rng.sample(range(400), rng.choice([3, 30, 70, 140])) for _ in range(12)]
    near = lambda x: [t for t in x if rng.random() > 0.06] + rng.sample(range(400, 900), rng.randint(0, max(1, len(x) // 12)))
    sets = [(rng.choice(["o", "p", None]), i, [f"w{t}" for t in near(rng.choice(base))]) for i in range(150)]
    sets += [("c", 1000 + i, ["copied", "words"]) for i in range(40)]
    rows = spark.createDataFrame(sets, "o string, k int, t array<string>")
    held, pairs = retrieval.alike_sets(rows, "o", "k", "t", 0.88, 100, 0.93, 0.85)
    assert held.where("o = 'c'").count() == 1 and pairs.where("p = q").count() == 0  # copies are held once
    like = lambda x, y: len(x & y) >= (0.93 if min(len(x), len(y)) >= 100 else 0.88) * len(x | y) or len(x & y) >= 0.85 * min(len(x), len(y))
    want = sorted((o, a, b) for o, a, x in sets for p, b, y in sets if o and o == p and a < b and x and y and like({*x}, {*y}))
    assert sorted(map(tuple, retrieval.similar_pairs(rows, "o", "k", "t", 0.88, 100, 0.93, 0.85).collect())) == want and len(want) > 800
    part = {r["k"]: r["component"] for r in retrieval.similar_groups(rows, "o", "k", "t", 0.85).collect()}
    assert len(part) == len(sets) and {part[1000 + i] for i in range(40)} == {1000}
    assert all(part[a] == part[b] for o, a, x in sets for p, b, y in sets if o and o == p and {*x} and len({*x} & {*y}) >= 0.85 * len({*x} | {*y}))


def test_arrays_take_few_bytes():
    rng = np.random.default_rng(0)
    for a in (np.array([0, 0, 1], np.uint32), np.array([], np.int64), np.array([255, 256], np.int64), np.array([2**63 + 1, 0], np.uint64), np.array([0.5, 1e-300])):
        assert lm.unsqueeze(lm.squeeze(a), a.dtype.type).tolist() == a.tolist()
    ids = np.sort(rng.integers(0, 2**46, 30_000).astype(np.uint64) // np.uint64(2**22))
    assert lm.unsteps(lm.steps(ids)).tolist() == ids.tolist() and len(lm.steps(ids)) < 0.8 * len(lm.squeeze(ids))


def test_katz_holds_what_chunks_were_told_once(spark, monkeypatch):
    tables, keep = {}, lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda rows, label: tables.setdefault(label, keep(rows, label)))
    docs = spark.createDataFrame([(i, f"a b{i % 7} c a b{i % 5} d") for i in range(90)], "doc_id long, text string")
    assert lm.katz_scores(docs, chunk_tokens=100, order=3).count() == 90
    there = {label: os.path.exists(t.inputFiles()[0].removeprefix("file://")) for label, t in tables.items()}
    assert there == {"lm-chunks": False, "lm-unigrams": False, "lm-told2": False, "lm-grams2": False, "lm-told3": True, "lm-grams3": True}


def test_katz_grams_take_little_memory():
    rng = np.random.default_rng(0)
    tokens = (rng.zipf(1.3, 300_000) % 50_000).astype(np.uint32)
    before = np.roll(tokens, 1).astype(np.int32)
    tracemalloc.start()
    context, word, at, inverse = lm._grams(before, tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * len(tokens)
    assert (context[inverse] == before).all() and (word[inverse] == tokens).all() and (inverse[at] == np.arange(len(at))).all()
    assert (np.diff(context.astype(np.int64) << 32 | word) > 0).all()


def test_katz_tokens_go_by_rank(spark):
    docs = spark.createDataFrame([(1, "b a a", True), (2, "a c", False)], "doc_id long, text string, train boolean").coalesce(1)
    row = lm.chunk_table(docs).first()
    ranks, places = lm.unsqueeze(row["tokens"], np.uint32), lm.unsqueeze(row["places"], np.uint32)
    hashes = lm.unsqueeze(row["words"], np.uint64)
    name = {xxhash.xxh64_intdigest(w): w for w in ("a", "b", "c")} | {lm.START: "start", lm.END: "end"}
    assert [name[int(h)] for h in hashes[places[ranks]]] == ["b", "a", "a", "end", "a", "c", "end"] and ranks.max() == 3 and ranks[1] == 0


def test_pages_are_moved_by_tasks(spark, tmp_path, monkeypatch):
    keys, folder = ["book", "page"], tmp_path / "p"
    rows = spark.createDataFrame([(f"b{i % 3}", i, f"t{i}") for i in range(40)] + [("a/b: c%[x]'=?", 1, "odd"), ("", 2, "empty"), (None, 3, None)], "book string, page int, text string")
    rows.select(*keys, F.coalesce("text", F.lit("")).alias("value")).repartition(4, *keys).write.partitionBy(*keys).text(str(folder))  # what Spark's writer left
    there = lambda: sorted(str(f.parent.relative_to(folder)) for f in folder.rglob("*") if f.is_file() and f.name not in ("_SUCCESS", "._SUCCESS.crc") and f.suffix != ".crc")
    before = there()
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.text", None)  # a file is no folder's output any more
    files.write_pages(rows, str(folder), keys, keys, "text")
    assert there() == before and len(before) == 43 and {f.name for f in folder.rglob("part-*")} == {"part-0.txt"}
    files.write_pages(rows.where("page = 7").withColumn("text", F.lit("new")), f"file://{folder}", keys, keys, "text")
    got = {(r["meta"]["book"], r["meta"]["page"]): r["body"] for r in files.read_markdown(spark, str(folder), least=0, names="*.txt").collect()}
    assert got == {(r["book"] or "", str(r["page"])): "new" if r["page"] == 7 else r["text"] or "" for r in rows.collect()}
    assert not [f for f in folder.iterdir() if f.name.startswith(".pages")]


def test_katz_chunks_go_one_at_a_time(spark, monkeypatch):
    names, seen, keep = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.compression.codec"), {}, lm.materialize

    def noted(rows, label):
        seen[label] = tuple(spark.conf.get(n) for n in names)
        return keep(rows, label)

    monkeypatch.setattr(lm, "materialize", noted)
    codec = spark.conf.get(names[1])
    docs = spark.createDataFrame([(i, f"a b{i % 7} c a") for i in range(30)], "doc_id long, text string")
    assert lm.katz_scores(docs, chunk_tokens=100, order=2).count() == 30
    assert seen.pop("lm-chunks")[1] == "uncompressed" and set(seen.values()) == {("1", "uncompressed")}
    assert (spark.conf.get(names[0]), spark.conf.get(names[1])) == ("512", codec)
