"""Every query with SQL against DuckDB, the others against brute force, and the functions on inline cases."""

import glob
import math
import os
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import ordered as O
from tessera.functions import text as T
from tessera.operators import records as R
from tessera.operators import retrieval, usage
from tessera.plans import registry
from tessera.sources import files
from tessera.streaming import windows

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.6f}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(name, spark, duck):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_ordered_folds():
    assert O.longest_non_decreasing([]) == [] and O.longest_non_decreasing([3, 2, 1]) == [0]
    assert O.longest_non_decreasing([1, 99, 2, 2, 3]) == [0, 2, 3, 4]
    assert O.longest_run_of_ones([5, 1, 7, 2, 3]) == [1, 3, 4] and O.longest_run_of_ones([9, 4]) == [0, 1]


def test_arithmetic():
    assert O.arithmetic("2*(3+4)/7") == 2 and O.arithmetic("1/0") is None and O.arithmetic("2 × 3 ÷ 4") == 1.5 and O.arithmetic("1+2x3") == 7 and O.arithmetic("2**3") == 8 and O.arithmetic("8//2") is None and O.arithmetic("y+1") is None and O.arithmetic("1" + "+1" * 400) == 401
    assert O.chain_faults("$1+1$ = 2") == [] and O.chain_faults("1+1 = 3") == ["E_ARITH_MISMATCH"] and O.chain_faults("값 1 = 2") == []
    assert O.chain_faults("1+1 = 2 = 3") == ["E_CHAIN_EQ_MISMATCH"] and O.chain_faults("1 < 3 < 2") == ["E_INEQ_CHAIN_MISMATCH"] and O.chain_faults("a = 1") == []
    assert O.chain_faults("1 <= 2") == [] and O.chain_faults("3 < 2") == [] and O.chain_faults("1 < ? < 0") == [] and O.chain_faults("1/3 = 0.3333333333") == []


def test_rate_cap(spark):
    seconds = [0.0] * 101 + [59.999, 60.0]
    passed, _, _ = windows.anchored_cap(seconds)
    assert passed == [True] * 100 + [False] * 2 + [True]
    got = registry.QUERIES["anchored_rate_cap"](spark, SF).collect()
    by_user = defaultdict(list)
    for r in got:
        by_user[r["user_id"]].append((r["ts"], r["passed"]))
    for rows in by_user.values():
        rows.sort()
        start, n = None, 0
        for at, passed in rows:
            if start is None or (at - start).total_seconds() >= 6 * 3600:
                start, n = at, 0
            n += 1
            assert passed == (n <= 2)


def test_packed_paragraphs(spark):
    chunks = defaultdict(dict)
    for r in registry.QUERIES["packed_paragraphs"](spark, SF).collect():
        chunks[r["doc_id"]][r["at"]] = r["chunk"]
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want, held = [], ""
        for p in (x for x in r["text"].strip(" ").replace("\n", "\n\n").split("\n\n") if x.strip(" ")):
            if held and len(held) + 2 + len(p) > 1500:
                want, held = [*want, held.strip(" ")], p
            else:
                held = f"{held}\n\n{p}" if held else p
        want += [held.strip(" ")] if held.strip(" ") else []
        got = chunks[r["doc_id"]]
        assert [got[i] for i in range(len(got))] == want


def test_subsequences(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    lines = defaultdict(list)
    for r in rows:
        lines[r["l_orderkey"]].append((r["l_shipdate"], r["l_partkey"], r["l_linenumber"]))
    for r in registry.QUERIES["non_decreasing_numbers"](spark, SF).collect():
        numbers = [x[2] for x in sorted(lines[r["l_orderkey"]])]
        best = [1] * len(numbers)
        for i in range(len(numbers)):
            best[i] = 1 + max((best[j] for j in range(i) if numbers[j] <= numbers[i]), default=0)
        kept = [int(x) for x in r["kept"].strip("[]").split(",")]
        assert kept == sorted(kept) and len(kept) == max(best)
    for r in registry.QUERIES["chains_of_ones"](spark, SF).collect():
        numbers = [x[2] for x in sorted(lines[r["l_orderkey"]])]
        longest = max(greedy_chain(numbers, i) for i in range(len(numbers)))
        assert r["length"] == (longest if longest > 1 else len(numbers))


def greedy_chain(numbers, at):
    n = 1
    for i in range(at + 1, len(numbers)):
        if numbers[i] == numbers[at] + 1:
            at, n = i, n + 1
    return n


def test_near_duplicate_segments(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sets = {r["doc_id"]: (r["source"], set(r["text"].lower().split())) for r in docs}
    part = {i: i for i in sets}
    for _ in range(3):
        for a, (s, x) in sets.items():
            for b, (t, y) in sets.items():
                if s == t and len(x & y) >= 0.85 * len(x | y):
                    part[a] = part[b] = min(part[a], part[b])
    assert {r["doc_id"]: r["component"] for r in registry.QUERIES["near_duplicate_segments"](spark, SF).collect()} == part
    assert {r["code"] for r in registry.QUERIES["arithmetic_gate"](spark, SF).collect()} == {"E_ARITH_MISMATCH"}


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, number", [("③", 3), ("3", 3), ("(3)", 3), ("[3]", 3), ("$3$", 3), ("3번", 3), ("③ (3)", 3), ("③ (4)", None), (None, None), ("12", None)])
def test_objective_answers(spark, text, number):
    assert one(spark, T.objective_answer(F.col("t")), t=text) == number


@pytest.mark.parametrize("text, number", [("[문항 12]", 12), ("[해설 7] x", 7), ("**3.** x", 3), ("예제 8 x", 8), ("문제  \n 9", 9), ("3번 문제", 3), ("[7] x", None), ("8) 다음", 8), ("9. $x$", 9), ("9. x", None), ("1.5 x", None), ("[문항 120] 5번", 5), ("4번 [문항 6]", 6), (" " * 300 + "3번", 3), ("x" * 260 + " 3번", None)])
def test_problem_numbers(spark, text, number):
    assert one(spark, T.problem_number(F.col("t")), t=text) == number


def test_text_functions(spark):
    assert one(spark, T.latin_and_hangul_tokens(F.col("t")), t="Sin2x함수의극한값 a") == ["sin", "함수의극", "한값"]
    assert one(spark, T.page_numbers(F.col("t"), 10), t="1, 5-3 9~12,x 7–7 0-2") == [1, 2, 3, 4, 5, 7, 9, 10]
    assert one(spark, T.equations(F.col("t")), t="x $ b $ and $$a$$ $ $") == ["a", "b"]
    assert one(spark, T.snippet([F.col("a"), F.col("b")], "key"), a=None, b="x" * 50 + "KEY") == "…" + "x" * 40 + "KEY"


def test_record_operators(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert R.prune(rows, rows.where("k = 1"), "k").count() == 1 and R.prune(rows, rows.where("false"), "k").count() == 2
    assert {tuple(r) for r in R.positional_fallback(rows.select("k"), spark.createDataFrame([(2, "q"), (9, "z")], "k int, v string"), "k", "k", "v").select("k", "v").collect()} == {(1, "q"), (2, "q")}
    alarm = usage.alarm(spark.createDataFrame([(None, None), (False, 0), (False, 3), (True, 1), (True, 2)], "ok boolean, a int"), "ok", "a").first()
    assert (alarm["runs"], alarm["failed"], alarm["alarm"]) == (5, 2, True) and alarm["retry_share"] == pytest.approx(3 / 8)
    pairs = retrieval.similar_pairs(spark.createDataFrame([("o", 1, ["a", "b"]), ("o", 2, ["a", "b", "c"]), ("p", 3, ["a", "b"])], "o string, k int, t array<string>"), "o", "k", "t", 0.6)
    assert [tuple(r) for r in pairs.collect()] == [("o", 1, 2)]
    repeated = [("o", 1, ["a", "b"]), ("o", 2, ["a", "b"]), ("p", 1, ["a", "b"]), ("p", 2, ["c", "d"]), ("q", 1, ["c", "d"]), ("q", 2, ["c", "d"])]
    pairs = retrieval.similar_pairs(spark.createDataFrame(repeated, "o string, k int, t array<string>"), "o", "k", "t", 0.6)
    assert sorted(tuple(r) for r in pairs.collect()) == [("o", 1, 2), ("q", 1, 2)]  # keys that recur under other owners
    far = spark.createDataFrame([("s", 1), ("s", 2), ("s", 2_000_000_000), ("t", 1), ("t", 2), ("t", 4)], "s string, n int")
    assert [tuple(r) for r in R.gaps(far, "s", "n").collect()] == [("t", [3])]
    rng = random.Random(1)
    sets = [("o", i, rng.sample("abcdefghij", rng.randint(1, 6))) for i in range(60)]
    got = retrieval.similar_pairs(spark.createDataFrame(sets, "o string, k int, t array<string>"), "o", "k", "t", 0.6, 4, 0.8, 0.75)
    like = lambda x, y: len(x & y) >= (0.8 if min(len(x), len(y)) >= 4 else 0.6) * len(x | y) or len(x & y) >= 0.75 * min(len(x), len(y))
    assert {(r["a"], r["b"]) for r in got.collect()} == {(a, b) for _, a, x in sets for _, b, y in sets if a < b and like({*x}, {*y})}
    box = lambda *v: dict(zip(("x0", "y0", "x1", "y1"), v, strict=True))
    boxes = spark.createDataFrame([(box(0, 0, 2, 2), box(1, 1, 3, 3)), (box(0, 0, 1, 1), box(5, 5, 6, 6)), (box(0, 0, 0, 0), box(0, 0, 0, 0))], "a struct<x0:int,y0:int,x1:int,y1:int>, b struct<x0:int,y0:int,x1:int,y1:int>")
    assert [r[0] for r in boxes.select(T.intersection_over_union(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 7), 0.0, 0.0]


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(None, "s", "c" * 30), ("x", "s", "short")], "id string, source string, content string")
    files.write_json_lines(rows, str(tmp_path / "kb"))
    got = files.read_json_lines(spark, str(tmp_path / "kb")).collect()
    assert len(got) == 1 and len(got[0]["id"]) == 12
    (tmp_path / "md" / "u").mkdir(parents=True)
    (tmp_path / "md" / "u" / "a.md").write_text("---\nbook: B: x\nbook: C\npage: 3\n---\nbody of the page")
    (tmp_path / "md" / "README.md").write_text("not a page at all")
    page = files.read_markdown(spark, str(tmp_path / "md")).collect()
    assert [(r["meta"], r["body"]) for r in page] == [({"book": "C", "page": "3"}, "body of the page")]
    manifest = spark.createDataFrame([('{"items":[{"questionNo":" 1 ","file":"a.png","diagramFiles":[" ","d"]},{"questionNo":"2"}]}',)], "j string")
    assert [tuple(r) for r in files.manifest_items(manifest, "j").collect()] == [("1", "a.png", ["d"])]
    table = str(tmp_path / "t")
    for batch in ([("f", 1), ("f", 2), ("g", 3)], [("f", 9)]):
        files.replace_by_key(spark.createDataFrame(batch, "k string, v int"), table, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(table).collect()) == [("f", 9), ("g", 3)]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(events.schema).parquet(source)

    def run(frame, name, mode="complete"):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    counts = run(windows.tumbling(stream(), "ts", ["event_type"], "1 day"), "tumbling")
    want = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    assert counts.agg(F.sum("n")).first()[0] == events.count() and counts.count() == want.count()
    assert run(windows.session(stream(), "ts", ["user_id"]), "sessions").agg(F.sum("n")).first()[0] == events.count()
    assert run(windows.distinct_events(stream(), "ts", ["user_id"], "100 days"), "firsts", "append").count() == events.select("user_id").distinct().count()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", windows.STORE)
    try:
        capped = run(windows.capped_stream(stream(), "user_id", "ts", 6 * 3600.0, 2), "capped", "append")
        want = windows.capped(events, "user_id", "ts", 6 * 3600.0, 2)
        assert capped.groupBy("user_id", "ts", "passed").count().exceptAll(want.groupBy("user_id", "ts", "passed").count()).count() == 0 and capped.count() == want.count()
        # three batches: the window open at the end of the first goes on in the second, and is dropped after the third
        for i, times in enumerate((["00:00:00", "00:00:10"], ["00:00:20", "00:01:00"], ["01:00:00"])):
            spark.createDataFrame([("u", f"2024-01-01 {t}") for t in times], "k string, t string").select("k", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.parquet(str(tmp_path / f"batches/p={i}"))
        parts = spark.readStream.schema("k string, t timestamp, p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "batches"))
        few = run(windows.capped_stream(parts, "k", "t", 60.0, 2, "0 seconds"), "few", "append")
        assert [r["passed"] for r in few.orderBy("t").collect()] == [True, True, False, True, True]
        state = spark.read.format("statestore").option("stateVarName", "window").load(str(tmp_path / "few"))
        assert state.count() <= 1
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = str(tmp_path / "out")
    q = stream().writeStream.foreachBatch(windows.upsert_sink(out)).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = windows.latest(spark.read.parquet(out), ["user_id"], "event_id")
    assert {(r["user_id"], r["event_id"]) for r in last.collect()} == {(r[0], r[1]) for r in events.groupBy("user_id").agg(F.max("event_id")).collect()}
