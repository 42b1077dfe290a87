"""Archives, versions of a table, files by key, and the index: what is written, bounds, repeats and conflicts."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as X
from tessera.operators import positions, retrieval
from tessera.operators import records as R
from tessera.sources import archives, files
from tessera.sources.versions import Conflict, VersionedTable, identified


def test_members_of_damaged_and_large_archives():
    deep = archives.zipped([("p.png", b"x")])
    for _ in range(7):
        deep = archives.zipped([("in.zip", deep)])
    assert [m[2:4] for m in archives.members(deep, "a.zip")] == [(6, "too_deep")]
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("b.png", b"\0" * 5000)
        z.writestr("s.png", b"12")
    assert [(m[0], m[3], m[4]) for m in archives.members(bomb.getvalue(), "a", most_bytes=100)] == [("a::b.png", "too_large", None), ("a::s.png", "ok", 2)]
    assert [m[3] for m in archives.members(bomb.getvalue(), "a", most_members=1)] == ["too_many"]
    assert [m[3] for m in archives.members(b"no archive", "a")] == ["damaged"] and [m[3] for m in archives.members(bomb.getvalue()[:-30], "a")] == ["damaged"]
    for manifest, found in ((b"{", 2), (b'{"items":[]}', 2), (b'{"items":[{"file":" b.png "},{}]}', 1), (b"[1]", 2), (b'{"items":[{"file":"q.png"}]}', 0)):
        data = archives.zipped([("x/b.png", b"1"), ("c.JPG", b"2"), ("d.txt", b"3"), ("manifest.json", manifest)])
        assert len(list(archives.members(data, "a"))) == found


def test_archive_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.zip").write_bytes(archives.zipped([("é/p.png", b"1"), ("in.zip", archives.zipped([("q.webp", b"22")]))]))
    (tmp_path / "d" / "b.zip").write_bytes(b"no archive")
    (tmp_path / ".hidden.zip").write_bytes(archives.zipped([("p.png", b"1")]))
    got = archives.read_archives(archives.archive_files(spark, str(tmp_path))).collect()
    assert sorted((r["label"], r["depth"], r["status"], r["bytes"]) for r in got) == [("a.zip::é/p.png", 0, "ok", 1), ("a.zip>in.zip::q.webp", 1, "ok", 2), ("b.zip", 0, "damaged", 10)]


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k", "k string, v int", buckets=3)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k string, v int")
    content = lambda version=None: sorted((r["k"] or "", r["v"]) for r in table.read(version).collect())
    assert table.version() == 0 and content() == []
    assert table.append(rows(("a", 1), ("b", 2), (None, 9)), "one") == 1 and table.append(rows(("a", 1), ("b", 2)), "one") == 1
    assert table.update(rows(("b", 5), ("c", 6)), "two") == 2
    assert content() == [("", 9), ("a", 1), ("b", 5), ("c", 6)] and content(1) == [("", 9), ("a", 1), ("b", 2)]
    # a job that fails while it stages leaves the table as it was
    with pytest.raises(Exception, match="(?i)division|divide"):
        table.update(rows(("a", 0)).withColumn("v", F.expr("cast(1 div v as int)")), "three")
    assert table.version() == 2 and content() == [("", 9), ("a", 1), ("b", 5), ("c", 6)]
    # another writer takes the next number first: the change is built on what that one left
    before, other = table._commit, VersionedTable(spark, str(tmp_path / "t"), "k", "k string, v int", buckets=3)

    def late(version, state):
        table._commit = before
        other.update(rows(("a", 7)), "other")
        return before(version, state)

    table._commit = late
    assert table.update(rows(("b", 8)), "four") == 4 and content() == [("", 9), ("a", 7), ("b", 8), ("c", 6)]
    table._commit = lambda version, state: False
    with pytest.raises(Conflict):
        table.append(rows(("z", 1)), "five")
    assert other.read().count() == 4
    named = identified(spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int"), "k", "c")
    assert [r["k"] for r in named.collect()] == [r["k"] for r in named.collect()] and named.where("k = 'x'").count() == 1 and named.where("length(k) = 12").count() == 1


def test_pages_by_key(spark, tmp_path):
    rows = spark.createDataFrame([("b 1", 1, "u\nv", "text\nof the page"), ("b 1", 2, None, None), ("c", 1, "w", "---\nx: y\n---\nz")], "book string, page int, url string, text string")
    for _ in range(2):
        files.write_pages(rows, str(tmp_path / "p"), ["book", "page"], ["book", "page", "url"], "text")
    files.write_pages(rows.where("book = 'c'").withColumn("text", F.lit("new")), str(tmp_path / "p"), ["book", "page"], ["book", "page", "url"], "text")
    assert len(list((tmp_path / "p").rglob("part-*.txt"))) == 3
    got = files.read_markdown(spark, str(tmp_path / "p"), least=0, names="*.txt").collect()
    assert sorted((r["meta"]["book"], r["meta"]["page"], r["meta"]["url"], r["body"]) for r in got) == [("b 1", "1", "u v", "text\nof the page"), ("b 1", "2", "", ""), ("c", "1", "w", "new")]
    files.write_manifests(rows, str(tmp_path / "m"), "book", "page", ["page", "url"])
    listed = {r["key"]: (r["total"], [tuple(i) for i in r["items"]]) for r in files.read_manifests(spark, str(tmp_path / "m"), "page int, url string").collect()}
    assert listed == {"b 1": (2, [(1, "u\nv"), (2, None)]), "c": (1, [(1, "w")])}


def test_index_skips_blocks_and_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 8)
    rng = random.Random(3)
    text = lambda: ["the", "of", "and"] + [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(0, 40))]
    rows = [(i, text()) for i in range(1500)] + [(5000 + i, ["the", "of", "and", f"z{i}", f"y{i}", f"x{i}"]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    queries = spark.createDataFrame([(i, [f"w{rng.randint(20, 400)}" for _ in range(4)] + ["the", "of"]) for i in range(12)] + [(99, ["nowhere"])], "item_id long, tokens array<string>")
    plain = lambda rows: sorted((r[0], r["rank"], r["key"], round(r["score"], 8)) for r in rows)
    for parts in ([docs], [docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")]):
        folder = str(tmp_path / f"i{len(parts)}")
        for i, part in enumerate(parts):
            X.add_source(part, "doc_id", "tokens", folder, f"s{i}")
        index = X.Index(spark, folder, [f"s{i}" for i in range(len(parts))])
        weights = index.weights(queries, "item_id", "tokens", {"w7": 2.0})
        needed = positions.checkpointed(index.needed(weights, 3))
        got = index.top_k(weights, 3, needed).collect()
        want = retrieval.top_k(queries, docs, "item_id", "doc_id", "tokens", 3, {"w7": 2.0}).withColumnRenamed("doc_id", "key").collect()
        assert plain(got) == plain(want) and len(got) == 36
        met = weights.join(index.blocks, "token").agg(F.sum("size")).first()[0]
        read = needed.agg(F.sum("size")).first()[0]
        assert read < 0.5 * met


def test_numbers_and_positions(spark):
    rng = random.Random(5)
    values = [rng.randint(0, 50) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = positions.numbered(rows, ["v"], "at").collect()
    assert sorted(r["at"] for r in got) == list(range(500)) and [r["v"] for r in sorted(got, key=lambda r: r["at"])] == sorted(values)
    assert positions.numbered(rows.where("false"), ["v"], "at").count() == 0
    left, right = spark.createDataFrame([(1,), (5,), (7,)], "k int"), spark.createDataFrame([(5, "a"), (6, "b")], "k int, v string")
    assert sorted(tuple(r) for r in R.positional_fallback(left, right, "k", "k", "v").select("k", "v").collect()) == [(1, "a"), (5, "a"), (7, None)]
    old = R.archived(spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), (None, 1), (None, None)], "n string, t int"), ["n"], "t")
    assert sorted((r["n"] or "", r["t"] or 0, r["archived"]) for r in old.collect()) == [("", 0, True), ("", 1, False), ("a", 1, True), ("a", 3, False), ("a", 3, False)]


def test_assisted_pairing(spark):
    plan = [(1, "s", 1, "problem", 0.9), (2, "s", 1, "problem", 0.6), (3, "s", 1, "solution", 0.7), (4, "s", 1, "solution", 0.5), (5, "s", 2, "problem", 0.9), (6, "t", 1, "problem", 0.9), (7, "t", 1, "solution", 0.9), (8, "t", None, "solution", 0.9), (9, "t", 1, "other", 0.9)]
    records = [(1, 10, False), (2, 30, False), (3, 5, None), (4, 99, None), (5, 1, False), (6, 1, True), (7, 1, False)]
    plan, records = spark.createDataFrame(plan, "id int, series string, no int, side string, confidence double"), spark.createDataFrame(records, "id int, chars int, filled boolean")
    pairs = R.assisted_pairing(plan, records)
    assert sorted(tuple(r) for r in pairs.collect()) == [("s", 1, 2, 3, False, 3), ("t", 1, 6, 7, True, 2)]
    assert tuple(R.pairing_counts(plan, pairs).first()) == (1, 9 - 5 + 1)


def test_listing_and_drafts(spark, tmp_path):
    import os

    for i, (name, text) in enumerate([("e 1/문항03_API초안.md", " 가\n"), ("e 1/합본_편집용.md", "나"), ("e 1/README.md", "x"), ("e 1/문항4_API초안.MD", " \n"), ("f/문항12_api초안.md", "다"), ("f/b.png", "123")]):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
        os.utime(tmp_path / "t" / name, (1_000_000_000 + i, 1_000_000_000 + i))
    got = files.read_drafts(spark, str(tmp_path / "t")).collect()
    assert sorted((r["exam"], r["question"], r["body"]) for r in got) == [("e 1", "3", "가"), ("e 1", "합본", "나"), ("f", "12", "다")]
    assert [r["name"] for r in files.listing(spark, str(tmp_path / "t"), (".PNG", "md")).collect()] == ["b.png", "문항12_api초안.md", "문항4_API초안.MD", "README.md", "합본_편집용.md", "문항03_API초안.md"]
    assert [bytes(r["content"]) for r in files.fetched(spark, str(tmp_path / "t"), "b.png").collect()] == [b"123"]
