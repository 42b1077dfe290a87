"""The operators against brute force, libraries and held-out labels, on small and on odd tables."""

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
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import archive, bpe, common, linededup, lm, packing, permutation, quality, simhash, tokencount, toxicity
from tessera.llm.components import connected_components

SF = "/root/testdata/sf0.001"
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a", "a b c d e f", "é日本 　x", "<|endoftext|> a<|endoftext|>", "x" * 3000, "w " * 3000, "\x00 a\t\r\n b", "▁ ▁▁a ", "same text here", "same text here"]
DOCS = "doc_id long, text string, lang string, source string, row int, n int, component string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 4 else None, t, None if i % 3 else "en", None if i % 2 else "s", 1, 2, "c") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().split()


def base(text):
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    chars = sum(len(x.decode()) for x in w)
    return len(w), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark, odd, documents, empty):
    for docs in (odd, documents):
        for r in quality.base_statistics(docs).collect():
            got = r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]
            assert got == base(r["text"])
            assert r["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0])
    assert quality.quality_rules(odd).count() == len(ODD) + 1
    assert quality.quality_rules(empty).count() == 0


def test_quality_rules_reject_outliers(spark):
    rng = random.Random(1)
    clean = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(60, 200))) for _ in range(150)]
    junk = [" ".join(w + "###" for w in t.split()) for t in clean[:10]]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + junk)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(150)) and not any(got[i] for i in range(150, 160))


def symbol_rows(clean, junk, marks):
    """clean plain texts, then junk texts with a symbol word after each tenth of marks words; one group."""
    rng = random.Random(1)
    texts = [["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(60, 200))] for _ in range(clean + junk)]
    dirty = [" ".join(w + "#" * (k % 10 < marks) for k, w in enumerate(t)) if i >= clean else " ".join(t) for i, t in enumerate(texts)]
    return [(i, t, "en", "s") for i, t in enumerate(dirty)]


def test_quality_rules_reject_a_third_of_junk(spark):
    rows = spark.createDataFrame(symbol_rows(160, 80, 10), "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(rows).collect()}
    assert all(got[i] for i in range(160)) and not any(got[i] for i in range(160, 240))


def test_quality_rules_reject_three_symbols_in_ten_words(spark):
    rows = spark.createDataFrame(symbol_rows(160, 40, 3), "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(rows).collect()}
    assert all(got[i] for i in range(160)) and not any(got[i] for i in range(160, 200))


def numpy_mcd(z, steps=6):
    """Squared distances by the same method on whole sorted half-samples, floors included."""
    def scatter(c):
        low = np.zeros_like(c)
        for j in range(5):
            low[j, j] = math.sqrt(max(quality.FLOORS[j] ** 2, c[j, j] - (low[j, :j] ** 2).sum()))
            for i in range(j + 1, 5):
                low[i, j] = (c[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
        return low

    def distances(m, low):
        y = np.linalg.solve(low, (z - m).T)
        return (y**2).sum(axis=0)

    def of(part, factor):
        return part.mean(axis=0), scatter(factor * np.cov(part.T, bias=True))

    best = None
    med = np.median(np.round(z * 100), axis=0)
    mad = np.median(np.abs(np.round(z * 100) - med), axis=0)
    for m, low in ((med / 100, scatter(np.diag((1.4826 * mad / 100) ** 2))), of(z, 1.0)):
        for _ in range(steps):
            m, low = of(z[np.argsort(distances(m, low))[: len(z) // 2]], quality.consistency(0.5))
        det = 2 * np.log(np.diag(low)).sum()
        if best is None or det < best[0]:
            best = det, m, low
    near = distances(*best[1:]) <= quality.chi2_quantile(quality.REWEIGHT, 5)
    return distances(*of(z[near], quality.consistency(quality.REWEIGHT)))


def test_robust_distances_against_numpy(spark):
    rows = spark.createDataFrame(symbol_rows(400, 100, 4), "doc_id long, text string, lang string, source string")
    stats = quality.transformed(quality.base_statistics(rows)).orderBy("doc_id").collect()
    want = numpy_mcd(np.array([[r[n] / quality.SCALE for n in quality.NAMES] for r in stats]))
    got = {r["doc_id"]: r for r in quality.quality_rules(rows).collect()}
    d2 = np.array([got[r["doc_id"]]["d2"] for r in stats])
    cutoff = quality.chi2_quantile(1 - quality.TAIL, 5)
    assert np.corrcoef(np.log1p(d2), np.log1p(want))[0, 1] > 0.99
    assert [got[r["doc_id"]]["kept"] for r in stats] == [x <= cutoff for x in want]


def test_small_groups_are_pooled(spark):
    rows = [(i, t, "en" if i < 150 else "fr", f"s{i % 3}") for i, t, *_ in symbol_rows(220, 0, 0)]
    rows += [(300 + i, t, "de", "big") for i, t, *_ in symbol_rows(120, 0, 0)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {(r["doc_id"] < 150, r["doc_id"] >= 300, r["mcd_group"]) for r in got} == {(True, False, "language"), (False, False, "all"), (False, True, "language and source")}


def test_fingerprints_and_links(spark, odd, documents, empty):
    assert simhash.fingerprint(b"A b", 3) == xxhash.xxh64_intdigest(b"a b", 42)
    for docs in (odd, documents):
        rows = simhash.near_duplicates(docs).collect()
        fps = [int(r["fingerprint"], 16) for r in rows]
        for r, text in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])), (x["text"] for x in sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))), strict=True):
            w = words((text or "").encode().lower().decode())
            h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
            assert int(r["fingerprint"], 16) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        part = list(range(len(fps)))

        def root(i):
            while part[i] != i:
                i = part[i]
            return i

        for i, a in enumerate(fps):
            for j in range(i):
                if (a ^ fps[j]).bit_count() <= 3:
                    part[root(i)] = root(j)
        least = defaultdict(lambda: None)
        for i, r in enumerate(rows):
            if r["doc_id"] is not None and (least[root(i)] is None or r["doc_id"] < least[root(i)]):
                least[root(i)] = r["doc_id"]
        assert all(r["component_id"] == least[root(i)] for i, r in enumerate(rows))
    assert simhash.near_duplicates(empty).count() == 0


def test_vantage_points_find_all_links(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = seeds[:1500].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)
    fps = np.concatenate([seeds, near]).view(np.int64)
    edges = simhash.hamming_links(spark.createDataFrame([(int(x),) for x in fps], "fp long"))
    parts = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(parts[int(a)] == parts[int(b)] for a, b in zip(seeds[:1500].view(np.int64), near.view(np.int64), strict=True) if a != b)


def test_deduplicate(spark, odd, empty):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)) for _ in range(20)]
    copies = [t.replace(t.split()[100], "changed", 1) for t in texts]
    rows = [(i, t) for i, t in enumerate(texts + copies + texts)]
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(20))
    out = simhash.deduplicate(odd)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} == {0, None, *range(5, 13)}
    assert simhash.deduplicate(empty).count() == 0


def near_copies():
    """Originals with copies of a few replaced words, so that the similarity lies on both sides of 0.8; all distinct."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    texts = []
    for k in range(12):
        one = [word() for _ in range(rng.choice([12, 60, 400]))]
        texts.append(" ".join(one))
        for _ in range(rng.randint(1, 12)):
            copy = [word() if rng.random() < 0.004 * k else w for w in one]
            texts.append(" ".join(copy))
    return sorted(set(texts))


def linked_parts(texts, least=0.8):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    part = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * math.sqrt(len(a) * len(sets[j])) - 1e-9 and part[i] != part[j]:
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    return part


def test_closure():
    texts = near_copies()
    root = simhash.closure([simhash.shingle_set(t.encode(), 5) for t in texts], 0.8)
    assert root.tolist() == linked_parts(texts) and len({*root.tolist()}) > 20
    assert len(simhash.closure([], 0.8)) == 0


@pytest.mark.parametrize("rows_a_task", [4096, 4])
def test_near_copies_against_brute_force(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(simhash, "CLUSTER_ROWS", rows_a_task)
    texts = near_copies()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.deduplicate(docs).collect()} == {*linked_parts(texts)}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    part = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    assert got == part


def test_permutation_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    x[300:400] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (None, [1.0] * 16), rows[5]]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(permutation.search(frame).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12)
        got[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in range(0, 600, 20):
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-sum(a * b for a, b in zip(x[i].tolist(), x[q].tolist(), strict=True)), i))[:20]
        assert len(got[q]) == 20
        hits += len({*best} & {*got[q]})
    assert set(got) == {*range(0, 600, 20)} and hits >= 0.9 * 600
    assert permutation.search(frame.where("false")).count() == 0


def test_line_dedup(spark, odd, empty):
    rng = random.Random(4)
    choice = ["a b c", "d e", "f g h i", "j", "k l", "", "m n o p q r"]
    rows = [(i, "\n".join(rng.choice(choice) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    gone, seen = defaultdict(set), set()
    for d, text in rows:
        lines = [(j, x) for j, x in enumerate(text.split("\n")) if x.split()]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(x.split()) for _, x in lines[i:j]) >= 9:
                    run = tuple(x for _, x in lines[i:j])
                    gone[d].update(q for q, _ in lines[i:j] if run in seen)
                    seen.add(run)
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 9).collect()}
    assert got == {d: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[d]) for d, t in rows}
    out = linededup.line_dedup(odd, 3).collect()
    assert len(out) == len(ODD) + 1 and sorted(r["text"] for r in out if r["doc_id"] in (12, 13)) == ["", "", "same text here"]
    assert [r["text"] for r in out if r["doc_id"] == 0] == [None]
    assert linededup.line_dedup(empty).count() == 0


def test_toxicity(spark, odd, empty):
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, marks = [], []
    for i in range(900):
        text = [rng.choice(plain) for _ in range(30)]
        if bad := rng.random() < 0.2:
            for _ in range(3):
                text[rng.randrange(30)] = rng.choice(["zounds", "zork" + rng.choice(plain), "quux!!"])
        rows.append((i, " ".join(text)))
        marks.append((i, 0, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in held) and 0 <= got[i]["score"] <= 1 for i in got)
    assert sum(got[i]["predicted"] == marks[i][2] for i in held) >= 0.97 * len(held)
    assert toxicity.toxicity(odd, labels).count() == len(ODD) + 1
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(odd, labels.where("false")).where("predicted = 1").count() == 0


def test_archives(spark):
    long = "<p>é</p>" * 300
    rows = [(1, "http://a/ b", long), (7, None, long), (3, "http://c", long), (4, "u", None), (5, "u", "x"), (6, "u", "x"), (8, "u", "long " * 400_000), (9, "u", "\n\r\n\r\nWARC/1.1"), (None, "v", "w")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    before = spark.conf.get(archive.ROWS)
    got = {r["page_id"]: r for r in archive.archive_round_trip(pages).collect()}
    assert len(got) == len(rows) and spark.conf.get(archive.ROWS) == before
    for page, _, html in rows:
        data, r = (html or "").encode(), got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 7) if page in (1, 3) else ("response", None))
    assert archive.archive_round_trip(pages.where("false")).count() == 0
    twice = archive.archive_round_trip(pages.where("page_id IN (1, 4)").unionByName(pages.where("page_id IN (1, 4)"))).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in twice) == [(1, "response"), (1, "response"), (4, "response"), (4, "response")]


def test_archives_of_any_bytes(spark, tmp_path):
    """Payloads that are no UTF-8, another address and type, a record without an HTTP head, and the file's description."""
    picture = bytes(range(256)) * 8
    rows = [(i, f"http://x/{i}", bytearray(picture if i % 2 else b"\xff\xfe\x00")) for i in range(4)]
    got = archive.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html binary")).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got) == [(i, len(d), hashlib.sha1(bytes(d)).hexdigest(), 3 if i == 1 else None) for i, _, d in rows]
    old = archive.arc_version_block(1, "old.arc", "19970101").encode() + b"\n" + archive.arc_record(1, "old.arc", 0, "dns:x.org", "199701011200", "text/dns", b"x.org 1.2.3.4", "1.2.3.4") + b"\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.arc").write_bytes(old)
    archive.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    data = b"".join(archive.plain(f.read_bytes()) for f in (tmp_path / "warc").glob("part-*"))
    records = {h["warc-type"]: (h, block) for h, block in archive.read_warc(data)}
    head, block = records["resource"]
    assert (head["content-type"], head["warc-ip-address"], head["warc-date"], block) == ("text/dns", "1.2.3.4", "1997-01-01T12:00:00Z", b"x.org 1.2.3.4")
    head, block = records["warcinfo"]
    assert head["warc-filename"] == "old.arc" and head["content-type"] == "application/warc-fields" and b"arc-version: 1 0 archive" in block


def test_arc_versions():
    for version in (1, 2):
        data = archive.arc_version_block(version, "n", "20240101000000").encode() + b"\n" + archive.arc_record(version, "n", 1, "http://a b/é", "20240101000000", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody\n\n") + b"\n\n" + archive.arc_record(version, "n", 2, None, "199901", "text/plain", b"") + b"\n"
        info, one, two = archive.read_arc(data)
        assert archive.described(info) and info["version"] == version
        assert archive.split_http(one["content"]) == (b"HTTP/1.1 200 OK\r\n\r\n", b"body\n\n") and one["version"] == version
        assert two["content"] == b"" and two["url"] == "-" and archive.warc_date(two["date"]) == "1999-01-01T00:00:00Z"
        with pytest.raises(ValueError):
            list(archive.read_arc(data[:-30]))


def test_token_counts(spark, odd, documents, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for docs in (odd, documents):
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        for r in tokencount.token_counts(docs, PIECES).collect():
            assert (r["n_bytes"], r["n_tokens"]) == (len(texts[r["doc_id"]].encode()), len(model.encode(texts[r["doc_id"]])))
    assert tokencount.token_counts(empty, PIECES).count() == 0
    count, rng = tokencount.PieceCounter(PIECES).count, random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice([" ", "  ", "\n", "a", "bc", "é", "▁", "\r", "\t", "\x00", "日", "<s>"]) for _ in range(rng.randint(0, 12)))
        assert count(text) == len(model.encode(text))


def test_bpe(spark, odd, documents, empty):
    library, mine, rng = Tokenizer.from_file(BYTE_BPE), bpe.ByteBpe(BYTE_BPE), random.Random(1)
    for docs in (odd, documents):
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        for r in bpe.encode_digests(docs, BYTE_BPE).collect():
            ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)))
    assert bpe.encode_digests(empty, BYTE_BPE).count() == 0
    assert {tuple(r["ids"]) for r in bpe.encode_documents(odd.where("doc_id = 5"), BYTE_BPE).collect()} == {tuple(mine.encode(ODD[5]))}
    for _ in range(500):
        text = "".join(rng.choice([" ", "  ", "\n", "a", "bc", "é", "'s", "\r", "\t", "\x00", "日", "<|endoftext|>", "12", "!"]) for _ in range(rng.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids and mine.decode(ids[1:]) == library.decode(ids[1:], skip_special_tokens=False)


def test_packing(spark, odd, documents, empty):
    library = Tokenizer.from_file(BYTE_BPE)
    for docs, bucket in ((odd, 700), (documents, 20_000)):
        pieces = packing.pack(docs, BYTE_BPE, bucket_tokens=bucket).collect()
        whole = Counter(tuple(library.encode(r["text"] or "", add_special_tokens=False).ids) + (0,) for r in docs.collect())
        assert sum(r["length"] for r in pieces) == sum(len(x) * n for x, n in whole.items())
        texts = {r["doc_id"]: np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4") for r in docs.collect()}
        sequences = defaultdict(list)
        for r in pieces:
            ids = texts[r["doc_id"]]
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(empty, BYTE_BPE).count() == 0


def test_sums_before_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3)
    rng = random.Random(9)
    sums = {(b, s): rng.randint(1, 90) for b in range(20) for s in "xyz" if rng.random() < 0.6}
    frame = spark.createDataFrame([(b, s, n) for (b, s), n in sums.items()], "bucket long, source string, n long")
    got = {(r["bucket"], r["source"]): r["all"] for r in packing._before(frame, "all").collect()}
    assert got == {(b, s): sum(n for (c, t), n in sums.items() if t == s and c < b) for b, s in sums}


def test_windows_hold_the_mixture():
    rng = np.random.default_rng(1)
    queues = [[(1000 * s + i, int(n)) for i, n in enumerate(rng.integers(1, 3000, size))] for s, size in enumerate((300, 100, 20))]
    totals = np.array([sum(n for _, n in q) for q in queues])
    windows = list(packing.fill(queues, totals / totals.sum(), np.zeros(3), 16_384))
    for w in windows[:-1]:
        got = np.zeros(3)
        for doc, _, n in w:
            got[doc // 1000] += n
        assert got.sum() == 16_384
    first = [sum(n for doc, _, n in w if doc < 1000) / 16_384 for w in windows[:-2]]
    assert max(abs(x - totals[0] / totals.sum()) for x in first) < 0.01
    assert sum(n for w in windows for _, _, n in w) == totals.sum()


class Katz:
    """A backoff model by dictionaries and recursion, with Turing's estimates worked out on its own."""

    def __init__(self, texts, order):
        self.order = order
        self.grams = [None] + [Counter() for _ in range(order)]
        for t in texts:
            for k in range(1, order + 1):
                padded = ["START"] * (k - 1) + t
                self.grams[k].update(tuple(padded[i : i + k]) for i in range(len(t)))
        self.turing = [None] + [self.estimates(c) for c in self.grams[1:]]
        self.after = [defaultdict(dict) for _ in range(order + 1)]
        for k in range(2, order + 1):
            for g, c in self.grams[k].items():
                self.after[k][g[:-1]][g[-1]] = c
        total = sum(self.grams[1].values())
        kept = sum(self.less(1, c) for c in self.grams[1].values())
        self.base = total if kept < total else total + 1
        self.unknown = 1 - kept / self.base
        self.weights = {}

    @staticmethod
    def estimates(counts):
        """r* / r for counts 1 to 5; for few data a share of one count is held back instead."""
        n = Counter(counts.values())
        top = 6 * n[6] / n[1] if n[1] else 1.0
        stars = {r: ((r + 1) * n[r + 1] / n[r]) / r if n[r] else -1.0 for r in range(1, 6)}
        turing = {r: (x - top) / (1 - top) if top != 1 else -1.0 for r, x in stars.items()}
        if n[1] and all(0 < x < 1 for x in turing.values()):
            return turing
        held = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
        return {r: (r - held) / r for r in range(1, 6)}

    def less(self, k, c):
        return c * self.turing[k].get(c, 1.0)

    def share(self, context):
        """(what a discounted count is divided by, the weight of the order below) of a context that was seen."""
        if context not in self.weights:
            k = len(context) + 1
            seen = self.after[k][context]
            total, kept = sum(seen.values()), sum(self.less(k, c) for c in seen.values())
            of = total if kept < total else total + 1
            self.weights[context] = of, (1 - kept / of) / max(1 - sum(self.chance(context[1:], w) for w in seen), 1e-12)
        return self.weights[context]

    def chance(self, context, word):
        if not context:
            c = self.grams[1].get((word,), 0)
            return self.less(1, c) / self.base if c else self.unknown
        seen = self.after[len(context) + 1].get(context)
        if not seen:
            return self.chance(context[1:], word)
        of, weight = self.share(context)
        return self.less(len(context) + 1, seen[word]) / of if word in seen else weight * self.chance(context[1:], word)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz(spark, documents, order):
    rows = documents.select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in lm.katz_scores(documents, chunk_tokens=9_000, entries=4_000, order=order).collect()}
    texts = {r["doc_id"]: [*r["text"].encode().lower().split(), "END"] for r in rows}
    model = Katz([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10], order)
    one = model.grams[1]
    n, v = sum(one.values()), len(one)
    for k in range(2, order + 1):  # probabilities add up to 1
        for context in list(model.after[k])[:: max(1, len(model.after[k]) // 5)]:
            assert sum(model.chance(context, w) for (w,) in one) + model.share(context)[1] * model.chance(context[1:], "never seen") == pytest.approx(1, abs=1e-6)
    for i, t in texts.items():
        padded = ["START"] * (order - 1) + t
        score = sum(math.log10(max(model.chance(tuple(padded[j : j + order - 1]), t[j]), 1e-300)) for j in range(len(t)))
        base_score = sum(math.log10((one[(w,)] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum((w,) in one for w in t), n)
        assert r["score"] == pytest.approx(score, abs=1e-6) and r["base_score"] == pytest.approx(base_score, abs=1e-6)


def test_katz_of_odd_rows(spark, odd, empty):
    assert lm.katz_scores(odd).count() == len(ODD) + 1
    assert lm.katz_scores(empty).count() == 0
    long = spark.createDataFrame([(i, "a b " * 150_000 if i < 2 else "b a a") for i in range(12)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.katz_scores(long, chunk_tokens=1_000).collect()}
    assert got[0]["n_tokens"] == 300_001 and got[0]["score"] == pytest.approx(got[1]["score"]) and all(r["score"] < 0 for r in got.values())


def test_packing_takes_long_blanks():
    text = "a" + " " * 1_000_000 + "b\n" * 20_000 + "\n" * 20_000
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    assert packing.encoder(BYTE_BPE)(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_archives_are_rolled(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(archive, "FILE_BYTES", 1_000)
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>" + "é" * (i if i != 20 else 4_000)) for i in range(23)], "page_id long, url string, html string").coalesce(1)
    archive.write_arc(pages, str(tmp_path / "arc"))
    sizes = sorted(len(archive.plain(f.read_bytes())) for f in (tmp_path / "arc").glob("part-*"))
    assert len(sizes) >= 5 and sizes[-2] < 1_500 and sizes[-1] > 8_000  # a long record is the last of its file
    got = archive.archive_round_trip(pages).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"]) for r in got) == [(i, 3 + 2 * (i if i != 20 else 4_000), "response") for i in range(23)]


def test_search_with_conflicting_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 1.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 2.0, 3.0])]
    got = permutation.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 5)
    monkeypatch.setattr(toxicity, "NEGATIVES", 7)
    docs = spark.createDataFrame([(i % 4, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    rows, _ = toxicity._labelled(docs, labels)
    sample = toxicity._sample(rows)
    assert sample.where("y = 1").count() <= 5 and sample.where("y = 0").count() <= 7


def test_search_in_parts_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8))
    x[100:] = x[0] + 0.01 * rng.normal(size=(300, 8))  # three in four vectors, and queries, near one pivot
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 4 = 0")
    monkeypatch.setattr(permutation, "PART", 16)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in permutation.search(frame, asked, k=5).collect()}
    assert len(got) == 100 * 5
    hits = 0
    for q in range(0, 400, 4):
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-float(x[i] @ x[q]), i))[:5]
        hits += len({*best} & {got[q, r] for r in range(1, 6)})
    assert hits >= 0.9 * 500


def test_join_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 8)
    rows = [(i, 7 if i % 3 == 0 else i % 50) for i in range(900)] + [(1000, None)]
    left = spark.createDataFrame(rows, "i long, k long").repartition(5)
    keyed = left.where("k < 40").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    got = sorted(tuple(r) for r in common.join_counted(left, keyed, ["k"], "n", 900).select("i", "k", "least").collect())
    least = {}
    for i, k in rows:
        if k is not None and k < 40:
            least[k] = min(i, least.get(k, i))
    assert got == sorted((i, k, least[k]) for i, k in rows if k in least)
