"""Functions of documents: by hand, and over documents against the same rules written with re."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import exam as E
from tessera.functions import text as T
from tessera.plans import documents as D
from tessera.plans import registry
from tessera.plans.inline import carry

SF = "/root/testdata/sf0.001"

MARKED = [
    ('■ 정답과 해설\n내용', '[정답 및 해설]\n내용', 'solution-section-standardized'),
    ('**3.** 다음 값', '[문항 3] 다음 값', 'problem-marker-standardized'),
    ('예제 7 : 다음', '[문항 7]\n다음', 'problem-marker-standardized'),
    ('12. 다음 값', '[문항 12]\n다음 값', 'problem-marker-standardized'),
    ('[문항 1] 그대로 1.5', '[문항 1] 그대로 1.5', ''),
    ('■ 정답: ③', '[정답] ③', 'answer-line-standardized'),
    ('[해설] 4 끝', '[해설 4] 끝', 'solution-marker-standardized'),
    ('1.5 배', '1.5 배', ''),
    ("가\n■ 정답과 해설\n나\n해설 및 정답\n다", "가\n[정답 및 해설]\n나\n해설 및 정답\n다", "solution-section-standardized"),
]
SIGNS = [
    ('₩frac{1}{2}', '\\frac{1}{2}'),
    ('＄x＄ ￦sqrt2', '$x$ \\sqrt2'),
    ('#wfrac{1}2 #logx #log x', '\\frac{1}2 #logx \\log x'),
    ('a\\cdot b \\cdots', 'a\\times b \\cdots'),
]
LOOSE = [
    ('이것은 답이다. 따라서 끝이다.', '이것은 답이다.\n따라서 끝이다.'),
    ('값은 3. 이제부터 한다', '값은 3.\n이제부터 한다'),
    ('식이 되고 그러므로 참', '식이 되고\n그러므로 참'),
    ('a\n\n\n\nb', 'a\n\nb'),
    ('3.14 이다', '3.14 이다'),
]
ANSWERS = [
    ('③', '', 'objective'),
    ('3번', '', 'objective'),
    ('12', '', 'short'),
    ('서술형 답', '', 'essay'),
    ('5', '과정을 쓰시오', 'objective'),
    ('x=2', '풀이 과정을 쓰시오', 'essay'),
    ('이것은 아주 긴 답이고 여러 말을 하는 문장이다. 그래서 서른여섯 자를 넘는다', '', 'essay'),
    ('②번 (값은 6이고 그 밖의 말이 매우 길게 이어진다. 그래도 고른 답이다)', '', 'short'),
]
HEADS = [
    ('[문항 12] x', 12),
    ('**3)** x', 3),
    ('유형 4', 4),
    ('5. 다음', 5),
    ('6번 문제', 6),
    ('[문항 120] 7번', 7),
    ('1.5 배', None),
    ('[8] x', None),
    (None, None),
]
CHAIN = "$$" + " = ".join(f"{c * 22}" for c in "abcdefgh") + "$$"
EQUALITIES = [(CHAIN, "$$" + "a" * 22 + " = " + "b" * 22 + " = \\cdots = " + "g" * 22 + " = " + "h" * 22 + "$$"), ("$$a = b$$", "$$a = b$$"), ("text = 1", "text = 1")]
EQUALITIES = [(CHAIN, "$$" + "a" * 22 + " = " + "b" * 22 + " = \\cdots = " + "g" * 22 + " = " + "h" * 22 + "$$"), ("$$a = b$$", "$$a = b$$"), ("text = 1", "text = 1")]


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("before, text, rules", MARKED)
def test_normalised(spark, before, text, rules):
    got = one(spark, E.normalised(F.col("t")), t=before)
    assert (got["text"], ",".join(got["rules"])) == (text, rules)


@pytest.mark.parametrize("function, cases", [(E.source_normalised, SIGNS), (E.loosened, LOOSE), (E.compacted, EQUALITIES), (T.problem_number, HEADS)])
def test_by_hand(spark, function, cases):
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").orderBy("i").select(function(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [c[1] for c in cases]


def test_answer_kinds_by_hand(spark):
    assert [one(spark, E.answer_kind(F.col("a"), F.col("e")), a=a, e=e) for a, e, _ in ANSWERS] == [k for *_, k in ANSWERS]


def texts(spark, cases, schema="id int, t string", **edits):
    return carry(registry.Reader(spark, SF), cases, schema, **(edits or {"t": D.after("t")})).collect()


def got(spark, name):
    return {r["id"]: r for r in registry.QUERIES[name](spark, SF).collect()}


def sub(pattern, to, text, count=0):
    return re.sub(pattern.replace(r"\z", r"\Z"), re.sub(r"\$(\d)", r"\\g<\1>", to), text, count=count, flags=re.A)


def test_normalised_documents(spark):
    found = got(spark, "ocr_normalised")
    for r in texts(spark, D.MARKED):
        text, rules = r["t"], []
        steps = [("solution-section-standardized", E.SOLUTION_SECTION, []), ("problem-marker-standardized", E.PROBLEM_MARKER, E.PROBLEM_HEADERS)]
        for name, there, patterns in steps:
            new = text
            if not re.search(there, r["t"], re.A):
                if name.startswith("solution"):
                    new = sub(E.SECTION_HEADER, "$1[정답 및 해설]\n", text, 1)
                    new = sub(E.LONE_HEADER, "$1[정답 및 해설]\n", text, 1) if new == text else new
                for p, marker in patterns:
                    new = sub(p, marker, new)
            rules, text = rules + [name] * (new != text), new
        new = sub(E.ANSWER_LINE, "$1[정답] $2", text)
        rules, text = rules + ["answer-line-standardized"] * (new != text), new
        new = re.sub(r"\[해설\s*([0-9]{1,3})\s*\]", r"[해설 \1]", re.sub(r"\[해설\]\s*([0-9]{1,3})", r"[해설 \1]", text, flags=re.A), flags=re.A)
        rules, text = rules + ["solution-marker-standardized"] * (new != text), new
        assert (found[r["id"]]["text"], found[r["id"]]["rules"]) == (text, ",".join(rules)), r["t"]


def test_signs_and_paragraphs_of_documents(spark):
    found = got(spark, "normalised_signs")
    for r in texts(spark, D.SIGNS):
        t = r["t"].translate(str.maketrans("₩￦＼＄", "\\\\\\$"))
        for name in ("sqrt", "frac", "log"):
            t = re.sub(rf"(?i)#w?{name}(?![A-Za-z0-9_])", lambda _, n=name: "\\" + n, t)
        assert found[r["id"]]["after"] == re.sub(r"\\cdot(?!s)", lambda _: r"\times", t)
    found = got(spark, "loosened_paragraphs")
    for r in texts(spark, D.LOOSE):
        t = r["t"].strip(" ")
        t = sub(r"([가-힣]{2,})\.\s+(?=[가-힣])", "$1.\n", t)
        t = sub(rf"(\d)\.\s+({E.CONNECTIVES}|주어진|구하면|따라)(?=[가-힣])", "$1.\n$2", t)
        t = sub(r"([^\n])\s+(따라서|그러므로|한편|또한|즉,|즉\s)(?=[\s가-힣])", "$1\n$2", t)
        assert found[r["id"]]["after"] == re.sub(r"\n{3,}", "\n\n", t).strip(" ")


def test_equalities_answers_and_numbers_of_documents(spark):
    found, long = got(spark, "compacted_equalities"), 0
    for r in texts(spark, [(1, "")], t=D.EQUALITY):
        inner = r["t"][2:-2].strip(" ")
        parts = [p.strip(" ") for p in inner.split("=") if p.strip(" ")]
        short = len(inner) >= 150 and inner.count("=") >= 6 and len(parts) >= 7
        long += short
        assert found[r["id"]]["after"] == (f"$${parts[0]} = {parts[1]} = \\cdots = {parts[-2]} = {parts[-1]}$$" if short else r["t"])
    assert long
    found = got(spark, "answer_kinds")
    chosen = re.compile(r"[①②③④⑤]|[1-5]\s*번|\(\s*[1-5]\s*\)")
    for r in texts(spark, D.ANSWERS, "id int, answer string, e string", e=D.some_after("e")):
        a = r["answer"].strip(" ")
        objective = re.fullmatch(r"[①②③④⑤]|[1-5]|[1-5]\s*번|[(\[$]\s*[1-5]\s*[)\]$]", a) is not None
        prose = len(a) >= 36 and not chosen.match(a) and re.search(r"[.!?。…]\s*\S", re.sub(r"\([^)]*\)", "", a))
        assert found[r["id"]]["kind"] == ("objective" if objective else "essay" if re.search(E.ESSAY, f"{a} {r['e']}") or prose else "short"), a
    found = got(spark, "problem_numbers")
    for r in texts(spark, D.HEADS):
        head = re.sub(T.BLANK + "+", " ", r["t"] or "")[:250].strip(" ")
        numbers = [int(m[1]) for p in T.NUMBER_PATTERNS if (m := re.search(p.replace(r"\z", r"\Z"), head, re.A))]
        assert found[r["id"]]["no"] == next((n for n in numbers if 1 <= n <= 99), None)
