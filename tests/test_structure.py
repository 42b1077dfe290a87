"""Structure rules that SQL does not express, against loops over lines."""

import base64
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import exam as E
from tessera.functions import structure as S
from tessera.plans import registry
from tessera.plans import structure as P

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r["id"]: r["t"] for r in P.solutions(registry.Reader(spark, SF)).collect()}


def kind_of(line):
    return next((name for name, p in E.LINE_KINDS if re.search(p, line, re.A)), "other")


def test_strict_headers(spark):
    got = {}
    for r in registry.QUERIES["strict_headers"](spark, SF).collect():
        got.setdefault(r["id"], set()).add(r["code"])
    for i, text in texts(spark).items():
        kinds = [kind_of(x) for x in text.replace("\r\n", "\n").split("\n")]
        at = 0
        while at < len(kinds) and kinds[at] == "blank":
            at += 1
        while at < len(kinds) and kinds[at] == "md_image":
            at += 1
        strict = at < len(kinds) and kinds[at] == "문제_번호접두"
        quick, body = (kinds.index(k) if k in kinds else -1 for k in ("빠른정답_번호접두", "해설"))
        want = {"no_numbered_problem"} if not strict else set()
        want |= {"no_numbered_answer"} if quick < 0 else set()
        want |= {"no_explanation"} if body < 0 else set()
        want |= {"wrong_order"} if strict and quick >= 0 and body >= 0 and not at < quick < body else set()
        assert got.get(i, set()) == want, text


def test_answer_conflicts(spark):
    got = {r["id"]: (r["conflicts"], r["mixed"]) for r in registry.QUERIES["answer_conflicts"](spark, SF).collect()}
    choice = lambda x: x.strip(" ").translate(str.maketrans("①②③④⑤", "12345"))
    for i, text in texts(spark).items():
        heads = [m.start() for m in re.finditer(r"\[정답\]", text)]
        conflicts, kinds = 0, set()
        for a, b in zip(heads, [*heads, len(text)][1:], strict=True):
            piece = text[a:b]
            answer = choice(re.match(r"\[정답\][ \t]*([^\n\r]*)", piece)[1])
            kinds.add("none" if not answer else "choice" if re.fullmatch("[1-5]", answer) else "value")
            said = [choice(x) for x in re.findall(r"정답(?:은|:)?\s*([①②③④⑤1-5])", piece, re.A)]
            conflicts += re.fullmatch("[1-5]", answer) is not None and any(s != answer for s in said)
        assert got[i] == (conflicts, len(heads) > 1 and {"choice", "value"} <= kinds), text


def test_method_blocks(spark):
    for r in registry.QUERIES["method_blocks"](spark, SF).collect():
        text = texts_of(spark)[r["id"]]
        heads = [m.start() for m in re.finditer(r"\[방법\s*\d+\]", text, re.A)]
        own = [h for k, h in enumerate(heads) if k == 0 or re.search(r"\n\s*\Z", text[:h])]
        pieces = [text[a:b].strip() for a, b in zip(own, [*own, len(text)][1:], strict=True)]
        assert r["methods"] == pieces and r["intro"] == (text[: own[0]].strip() if own else text.strip())


_kept = {}


def texts_of(spark):
    if not _kept:
        _kept.update(texts(spark))
    return _kept


@pytest.mark.parametrize("before, after", [("a \\[ x = 1. \\] b \\( y \\) c", "a $$x = 1$$ b $y$ c"), ("plain", "plain")])
def test_delimiters(spark, before, after):
    assert spark.createDataFrame([(before,)], "t string").select(S.normal_delimiters(F.col("t"))).first()[0] == after


def test_pictures(spark):
    jpeg = bytes.fromhex("FFD8FFE1000800112233445500FFC20011080010002003") + bytes(10)
    cases = [jpeg, b"\xff\xd8\xff" + bytes(20), b"BM" + bytes(10), b"GIF87a\x01\x00\x02\x00", b"\x89PNG\r\n\x1a\n" + bytes(8) + b"\x00\x00\x00\x05\x00\x00\x00\x06", b"no picture", b""]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, b binary").orderBy("i")
    got = [r["r"] and tuple(r["r"]) for r in rows.select(S.raster(F.col("b")).alias("r")).collect()]
    assert got == [("jpg", 32, 16), ("jpg", None, None), ("bmp", None, None), ("gif", 1, 2), ("png", 5, 6), None, None]
    urls = [("data:image/png;base64," + base64.b64encode(b"abc").decode()[:2] + " \n" + base64.b64encode(b"abc").decode()[2:],), ("data:text/plain;base64,YWJj",), ("data:image/png;base64,%%%",), (None,)]
    got = spark.createDataFrame(urls, "u string").select(S.data_url(F.col("u")).alias("b")).collect()
    assert [r["b"] and bytes(r["b"]) for r in got] == [b"abc", None, None, None]
