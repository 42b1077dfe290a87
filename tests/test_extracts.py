"""Splitters, the masked scan, markup and damage against plain Python; folds over keys of any size."""

import re
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.functions import markup, scan
from tessera.functions import splitters as S
from tessera.functions.damage import damaged
from tessera.operators.folds import ordered_fold
from tessera.plans import extracts, registry

SF = "/root/testdata/sf0.001"


def texts(spark):
    out = defaultdict(list)
    for r in extracts.marked_lines(registry.Reader(spark, SF)).collect():
        out[r["doc_id"]].append((r["place"], r["text"]))
    return {i: "\n".join(t for _, t in sorted(lines)) for i, lines in out.items()}


def longest(numbers, follows):
    """The length of a longest subsequence in which each number follows the one before."""
    best = [1] * len(numbers)
    for j in range(len(numbers)):
        best[j] = 1 + max((best[i] for i in range(j) if follows(numbers[i], numbers[j])), default=0)
    return max(best, default=0)


def test_numbered_items(spark):
    got = defaultdict(list)
    for r in registry.QUERIES["numbered_items"](spark, SF).collect():
        got[r["doc_id"]].append((r["place"], r["number"], r["piece"]))
    head = r"(?:^|\n)\s*(?:\[문항\s*(\d{1,3})\]|\[해설\s*(\d{1,3})\]|(\d{1,3})\s*[.)]|(\d{1,3})\s*번\s)"
    for doc, text in texts(spark).items():
        numbers = [n for n in (int(next(g for g in m.groups() if g)) for m in re.finditer(head, text, re.A)) if 0 < n <= 100]
        found = sorted(got[doc])
        assert [p for p, *_ in found] == list(range(len(found))) and len(found) == longest(numbers, lambda a, b: a <= b)
        assert [n for _, n, _ in found] == sorted(n for _, n, _ in found)
        rest = text
        for _, number, piece in found:  # the pieces lie in the text one after another, each behind its number
            assert str(number) in rest and piece in rest
            rest = rest[rest.index(piece) + len(piece) :] if piece else rest


def test_split_questions(spark):
    by_hand = "머리말\r\n1. 첫 문제 [3점]\t값은\n\n\n\n2) [4점] 둘째 3번 시도\n(3) 셋째 12번 끝 9.5 배\n51. 없음"
    # the first head with the next number counts, wherever it stands
    assert S.questions(by_hand) == [(1, None, "첫 문제 [3점] 값은"), (2, 4, "둘째"), (3, None, "시도\n(3) 셋째 12번 끝 9.5 배\n51. 없음")]
    assert S.questions("") == [] and S.questions("본문만") == []
    assert S.questions("1. a\n2. [2점] b\n3. c") == [(1, None, "a"), (2, 2, "b"), (3, None, "c")]
    got = defaultdict(list)
    for r in registry.QUERIES["split_questions"](spark, SF).collect():
        got[r["doc_id"]].append((r["number"], r["points"], r["content"]))
    for doc, text in texts(spark).items():
        assert got[doc] == S.questions(text)


def test_solved_problems(spark):
    text = "1. 가 2. 나\n2. 다\n[정답 및 해설]\n1. 짧다\n1. [정답] ③ 길게 푼다\n2. 풀이"
    assert S.solved_problems(text) == [(1, "가 2. 나", "[정답] ③ 길게 푼다", "③ 길게 푼다"), (2, "다", "풀이", "")]
    marked = "1. 가\n2. 나 [해설 2] [정답] 5\n끝 [해설 1] x"
    assert [(n, s, a) for n, _, s, a in S.solved_problems(marked)] == [(1, "x", ""), (2, "[정답] 5\n끝", "5")]
    assert S.solved_problems("1. 하나뿐") == []
    found = registry.QUERIES["solved_problems"](spark, SF).collect()
    whole = texts(spark)
    assert found and all((r["number"], r["question"], r["solution"], r["answer"]) in S.solved_problems(whole[r["doc_id"]]) for r in found)


def masked(text):
    """What a scanner that goes from sign to sign leaves outside, and where it met something unclosed."""
    keep, i, open_ = [True] * len(text), 0, None
    while i < len(text):
        for sign in ("```", "$$", "$"):
            escaped = sign != "```" and (len(text[:i]) - len(text[:i].rstrip("\\"))) % 2 == 1
            if text.startswith(sign, i) and not escaped:
                end = text.find(sign, i + len(sign))
                if end < 0:
                    open_ = (i, {"```": "unclosed_fence", "$$": "unclosed_display", "$": "unclosed_inline"}[sign])
                    keep[i:] = [False] * (len(text) - i)
                    return keep, open_
                keep[i : end + len(sign)] = [False] * (end + len(sign) - i)
                i = end + len(sign)
                break
        else:
            i += 1
    return keep, open_


def scanned(text):
    text = text.replace("\r\n", "\n")
    keep, open_ = masked(text)
    lines = text.split("\n")
    line = lambda at: text.count("\n", 0, at) + 1
    hits = [(line(open_[0]), open_[1])] if open_ else []
    for pattern in scan.PATTERNS:
        for m in re.finditer(pattern, text, re.A):
            if all(keep[m.start() : m.end()]) and not lines[line(m.start()) - 1].strip().startswith("!["):
                hits.append((line(m.start()), m[0][:80]))
    out = []
    for n, match in hits:
        row = (n, match, lines[n - 1].strip()[:120])
        if not any(row[:2] == o[:2] and row[2][:40] == o[2][:40] for o in out):
            out.append(row)
    return out


PIECES = ["$", "$$", "```", "\\$", "\\\\$", "\n", "\\frac", "\\begin{a}", "\\[", "x ", "\\,", "![p](\\frac)", "\\Alpha1", "\\_", "\\end { b }", "\r\n"]


def test_stray_commands(spark):
    cases = ["".join(c) for n in (1, 2, 3) for c in combinations(PIECES, n)]
    cases += ["".join(PIECES[(i * k) % len(PIECES)] for k in range(1, 14)) for i in range(300)] + ["", "a\n\n\\frac b\n$x$ \\sqrt{2}\n```\n\\frac\n```\n\\pi", "x" * 5000 + "\\frac " * 3]
    frame = spark.createDataFrame(list(enumerate(cases)), "id int, t string").repartition(4)
    got = {r["id"]: [tuple(h) for h in r["h"]] for r in frame.select("id", scan.stray_commands(F.col("t")).alias("h")).collect()}
    wrong = [(cases[i], got[i], scanned(cases[i])) for i in got if got[i] != scanned(cases[i])]
    assert not wrong, wrong[:3]
    assert spark.createDataFrame([(None,)], "t string").select(scan.stray_commands(F.col("t"))).first()[0] is None


def test_stray_commands_of_documents(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = defaultdict(list)
    for r in registry.QUERIES["stray_commands"](spark, SF).collect():
        got[r["doc_id"]].append((r["line"], r["match"], r["text"]))
    for doc, t in text.items():
        for old, new in extracts.MARKS:
            t = t.replace(old, new.replace("\\\\", "\\"))
        assert got[doc] == scanned(t)


@pytest.mark.parametrize("text, items", [("<CHAR a>x &amp;lt; y</CHAR><PICTURE z><EQUATION>\n<SCRIPT> a over b </SCRIPT>q</EQUATION><CHAR></CHAR><CHAR>1\n2</CHAR>", [("T", "x < y"), ("P", "[FIGURE]"), ("E", "a over b"), ("T", "1\n2")]), ("", []), ("<CHAR>a<b></CHAR>", [])])
def test_markup(spark, text, items):
    got = spark.createDataFrame([(text,)], "t string").select(markup.items(F.col("t")).alias("i")).first()["i"]
    assert [(i["kind"], i["value"]) for i in got] in (items, [("T", "x &lt; y"), *items[1:]])


def test_damaged(spark):
    cases = ["① ② 값 ③", "①  ②   ③\n", "자녀  명이 10  원 3  개 ", "a\n" * 20, None, "$ $" * 5]
    got = [tuple(r) for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").orderBy("i").select(F.inline(F.array(damaged(F.col("t"))))).collect()]
    assert got == [(0, False), (0, False), (3, False), (20, True), (None, None), (5, False)]


def test_folds_stream_keys_of_any_size(spark):
    rows = spark.range(0, 30_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).union(spark.createDataFrame([(None, 5)], "k long, v long"))
    got = ordered_fold(rows.repartition(9), ["k"], ["v"], lambda state, row: ((state or 0) + row["v"], (row["v"] if state is None else state + row["v"],)), "total long")
    ends = {r["k"]: r["total"] for r in got.groupBy("k").agg(F.max("total").alias("total")).collect()}
    assert ends == {0: sum(range(0, 30_000, 3)), 1: sum(range(1, 30_000, 3)), 2: sum(range(2, 30_000, 3)), None: 5}
