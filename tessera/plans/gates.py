"""Queries of the row-quality rules over cases that documents carry: one row per document and code."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import issues as I
from ..functions import text as T
from .inline import after, carried, carry
from .registry import query

LONG = "주어진 식을 정리하면 다음과 같은 결과를 얻을 수 있으므로 조건을 만족한다. "
DRAFTS = [
    (1, "③", LONG + "따라서 정답은 ③"),
    (2, "3", LONG + "정답은 ② 가 아니라 정답은 3"),
    (3, "(2)", LONG + "정답 ④"),
    (4, "7", "짧다"),
    (5, "", LONG + "정답은 5"),
    (6, "①", LONG + "화질 문제로 풀 수 없"),
    (7, "①", LONG + "s = sin x 이고 c = cos x 이므로"),
    (8, "①", LONG + "\n$x+1=2$ .\n끝"),
    (9, "①", LONG + "p iff q"),
    (10, "①", LONG + "Taylor series 를 쓰면"),
    (11, "①", LONG + "테일러 급수를 쓰고 정답은 1"),
    (12, None, LONG + "정답은 1"),
    (13, "①", None),
    (14, "①", LONG + "![p](a.png)\n$$a=b$$."),
    (15, "12", LONG + "different determination 정답은 2"),
]
ROWS = carried(DRAFTS, "id, answer, explanation", explanation=after("explanation"))
FIRST = "regexp_extract({0}, '([①②③④⑤])', 1)"


def union(source: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT id, '{code}' AS code FROM {source} WHERE {rule}" for code, rule in rules.items())


def some_line(column: str, pattern: str) -> str:
    return f"len(list_filter(string_split({column}, chr(10)), lambda x: NOT starts_with(trim(x), '![') AND regexp_matches(trim(x), '{pattern}'))) > 0"


def first_place(column: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({column}, '{pattern}') THEN strpos({column}, regexp_extract({column}, '{pattern}')) ELSE 0 END"


def exploded(frame, issues):
    return frame.select("id", F.explode(issues).alias("code"))


OWN = f"CASE WHEN {FIRST.format('answer')} <> '' THEN {FIRST.format('answer')} WHEN regexp_matches(answer, '(^|[^A-Za-z0-9_])[1-5]([^A-Za-z0-9_]|$)') THEN translate(regexp_extract(answer, '(^|[^A-Za-z0-9_])([1-5])([^A-Za-z0-9_]|$)', 2), '12345', '①②③④⑤') ELSE trim(answer) END"
LAST = f"translate(regexp_extract_all(explanation, '{I.CONCLUSION}', 1)[-1], '12345', '①②③④⑤')"


@query(union(ROWS, {
    "E_CONTENT_SHORT": "length(trim(explanation)) < 40",
    "E_CONTENT_BANNED_PHRASE": f"regexp_matches(explanation, '{I.BANNED}')",
    "E_ANSWER_MISMATCH": f"{LAST} <> {OWN} AND {OWN} <> ''",
    "E_MATH_SHORTHAND_SUBSTITUTION": f"regexp_matches(regexp_replace(explanation, '\\s+', ' ', 'g'), '{I.SHORTHAND}')",
    "E_MATH_TRAILING_PERIOD": some_line("explanation", I.TRAILING),
    "E_IFF_TOKEN": f"regexp_matches(explanation, '{I.IFF}')",
    "E_CURRICULUM_OUT_OF_SCOPE": " OR ".join(f"regexp_matches(explanation, '{p}')" for _, p in I.CONCEPTS),
}))
def draft_issues(read):
    return exploded(carry(read, DRAFTS, "id int, answer string, explanation string", explanation=after("explanation")), I.content_issues(F.col("answer"), F.col("explanation")))


CHUNKS = [
    (1, "[문제]\n식 $x=1$\n[빠른 정답] ①\n[해설]\n풀이"),
    (2, "[문제 3]\n식\n[정답] ①\n[해설]\n풀이"),
    (3, "[해설]\n풀이\n[문제]\n식\n[빠른정답] 2"),
    (4, "본문만 있다"),
    (5, "[정답] 1\n[문제] 식\n[빠른 정답] 1\n[해설] 풀이 $a\\in[0,1]$"),
    (6, "[문제]\n<보기>\nㄱ. 첫째\n</보기>\n[빠른 정답] 1\n[해설]\n$x=2$ .\n![그림](a.png)"),
    (7, "[문제]\n<보기>\n\n</보기>\n[빠른 정답] 1\n[해설]\n![참고 도형 1](b.png)\nx Rightarrow y"),
    (8, "[문제]\n<보기> 가 <보기>\n</보기>\n[빠른 정답] 1\n[해설]\n$$y = 3.$$"),
    (9, "[문제]\n가 </보기>\n[빠른 정답] 1\n[해설]\n\\Rightarrow 은 된다 ∈ [0,1]"),
    (10, "[문제]\n<보기>\n" + "가" * 201 + "\n</보기>\n[빠른 정답] 1\n[해설]\n끝"),
    (11, "[문제]\n</보기> 뒤집힘 <보기>\n[빠른 정답] 1\n[해설]\n끝"),
    (12, None),
]
CHUNK_ROWS = carried(CHUNKS, "id, chunk", chunk=after("chunk"))
BODY = r"(?s)\[문제(?:\s+\d+)?\]\s*(.*?)\n?\s*(?:\d+\)\s*)?\[(?:빠른\s*정답|정답)\]"
SPLIT_ROWS = f"(SELECT id, regexp_extract(chunk, '{BODY}', 1) AS p, regexp_extract(chunk, '(?s)\\[해설\\]\\s*(.*)', 1) AS e FROM {CHUNK_ROWS} WHERE chunk IS NOT NULL)"
PLACES = f"(SELECT id, {first_place('chunk', I.PROBLEM)} AS p, {first_place('chunk', I.QUICK)} AS q, {first_place('chunk', I.EXPLANATION)} AS e, {first_place('chunk', I.LEGACY)} AS old FROM {CHUNK_ROWS} WHERE chunk IS NOT NULL)"
HEADERS = {"no_problem": "p = 0", "legacy_answer_only": "q = 0 AND old > 0", "no_quick_answer": "q = 0 AND old = 0", "no_explanation": "e = 0", "wrong_order": "p > 0 AND q > 0 AND e > 0 AND NOT (p < q AND q < e)", "legacy_before_quick": "old > 0 AND q > 0 AND old < q"}


def chunks(read):
    return carry(read, CHUNKS, "id int, chunk string", chunk=after("chunk")).where("chunk IS NOT NULL")


@query(union(PLACES, HEADERS))
def header_gate(read):
    return exploded(chunks(read), I.header_issues(F.col("chunk")))


OPEN, CLOSE = "len(regexp_extract_all(p, '<보기>'))", "len(regexp_extract_all(p, '</보기>'))"
INNER = "regexp_extract_all(p, '(?s)<보기>\\s*(.*?)</보기>', 1)"
FILLED = f"list_transform({INNER}, lambda b: list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x)), lambda x: x <> ''))"
TAGS = {
    "close_without_open": f"{OPEN} = 0 AND {CLOSE} > 0",
    "unbalanced": f"{OPEN} > 0 AND {OPEN} <> {CLOSE}",
    "empty_block": f"{OPEN} > 0 AND {OPEN} = {CLOSE} AND len(list_filter({FILLED}, lambda b: len(b) = 0)) > 0",
    "long_line": f"{OPEN} > 0 AND {OPEN} = {CLOSE} AND len(list_filter(flatten({FILLED}), lambda x: length(x) > 200)) > 0",
    "crossed": f"{OPEN} > 0 AND {OPEN} = {CLOSE} AND len({INNER}) <> {OPEN}",
}


@query(union(SPLIT_ROWS, TAGS))
def tag_gate(read):
    return exploded(chunks(read), I.tag_issues(I.bodies(F.col("chunk"))[0]))


def notation(side: str, figures: bool) -> dict[str, str]:
    rules = {"equation_period": some_line(side, I.PERIOD), "membership_interval": some_line(side, I.MEMBERSHIP), "residue_word": some_line(side, I.RESIDUE)}
    if figures:
        rules["figure"] = f"len(list_filter(string_split({side}, chr(10)), lambda x: regexp_matches(x, '{I.FIGURE}') AND NOT regexp_matches(x, '{I.OWN_FIGURE}'))) > 0"
    return rules


@query(union(SPLIT_ROWS, notation("e", True)))
def notation_gate(read):
    return exploded(chunks(read), I.notation_issues(I.bodies(F.col("chunk"))[1]))


@query(" UNION ALL ".join([union(PLACES, HEADERS), union(SPLIT_ROWS, {f"p:{c}": r for c, r in (TAGS | notation("p", False)).items()}), union(SPLIT_ROWS, {f"e:{c}": r for c, r in notation("e", True).items()})]))
def export_readiness(read):
    return exploded(chunks(read), I.export_issues(F.col("chunk")))


OUTPUTS = [
    (1, '{"answer":"③","explanation_steps":[{"text":"' + "가" * 30 + '","equation":"x"},{"text":"' + "나" * 30 + '","equation":"y"}]}'),
    (2, '```json\n{"answer":" ","explanation_steps":[{"text":"' + "다" * 60 + '","equation":"x"}]}\n```'),
    (3, "no object at all"),
    (4, '{"answer":"1"}'),
    (5, '{"answer":"1","explanation_steps":[{"text":"\\\\frac{1}{2} ' + "라" * 60 + '","equation":""},{"text":"x","equation":""}]}'),
    (6, '{"answer":"1","explanation_steps":[{"equation":"x"},{"text":"y"}]}'),
]
NAMED = "replace(replace(c.raw, '가', coalesce(d.source, '')), '라', coalesce(d.lang, ''))"
CLEANED = "(SELECT id, trim(regexp_replace(regexp_replace(raw, '(?i)^```(json)?\\s*\\n?', ''), '\\n?```\\s*$', '')) AS j FROM " + carried(OUTPUTS, "id, raw", raw=NAMED) + ")"
PARSED = f"(SELECT id, json_extract_string(j, '$.answer') AS a, json_extract(j, '$.explanation_steps') AS s, coalesce(array_to_string(list_transform(json_extract(j, '$.explanation_steps[*]'), lambda x: coalesce(json_extract_string(x, '$.text'), '')), ' '), '') AS t FROM {CLEANED} WHERE json_valid(j))"
LEFT_OVER = r"\\(frac|sqrt|begin|end|left|right|cdot|times|sum|int)"


@query(f"SELECT id, 'V1_json' AS code FROM {CLEANED} WHERE NOT json_valid(j) UNION ALL " + union(PARSED, {"V2_answer": "coalesce(trim(a), '') = ''", "V2_steps": "s IS NULL", "V3_few_steps": "json_array_length(s) < 2", "V4_short": "length(t) < 50", "V6_latex": f"regexp_matches(t, '{LEFT_OVER}')"}))
def output_gate(read):
    return exploded(carry(read, OUTPUTS, "id int, raw string", raw=NAMED), I.output_issues(F.col("raw")))


RUNS = [
    (1, "Quota exceeded|429 again"), (2, "request TIMEOUT"), (3, "JSON parse"), (4, ""), (5, "fetch failed"), (6, "mathpix 500"), (7, "Gemini down"),
    (8, "invalid_grant"), (9, "빈  텍스트"), (10, "what"), (11, "형식 미달|what"), (12, None), (13, "rate limit"), (14, "rate_limit"),
]
WITH_SOURCE = "c.errors || '|' || coalesce(d.source, '')"
ERROR_CASES = " ".join(f"WHEN regexp_matches(lower(e), '{p}') THEN '{n}'" for n, p in I.ERRORS)


@query(f"""SELECT class, count(*) AS n, array_to_string(list(id ORDER BY id)[1:3], ',') AS examples FROM (SELECT id, CASE WHEN e = '' THEN 'no-detail' {ERROR_CASES} ELSE 'other' END AS class
FROM (SELECT id, unnest(string_split(coalesce(errors, ''), '|')) AS e FROM {carried(RUNS, 'id, errors', errors=WITH_SOURCE)})) GROUP BY 1""")
def error_classes(read):
    """Errors by class, with the first three runs of each; a run without any counts as no-detail."""
    rows = carry(read, RUNS, "id int, errors string", errors=WITH_SOURCE).select("id", F.explode(F.split(F.coalesce("errors", F.lit("")), r"\|")).alias("e"))
    rows = rows.select("id", F.when(F.col("e") == "", "no-detail").otherwise(T.first_matching(F.lower("e"), I.ERRORS, "other")).alias("class"))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("class").orderBy("id"))).where("r <= 3")
    examples = first.groupBy("class").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("examples"))
    return rows.groupBy("class").agg(F.count("*").alias("n")).join(examples, "class")


STEPS = [(1, '{"Stage":"형식 미달"}'), (1, '{"x":"JSON 파싱 실패, format mismatch"}'), (2, '{"x":"Cannot read header"}'), (3, '{"x":"fine"}'), (3, None)]


@query("SELECT code, count(*) AS n FROM (" + union(carried(STEPS, "id, step", step=after("step")), {n: f"regexp_matches(lower(step), '{p}')" for n, p in I.FORMATS}) + ") GROUP BY 1")
def format_labels(read):
    rows = carry(read, STEPS, "id int, step string", step=after("step"))
    return rows.select(F.explode(T.all_matching(F.lower("step"), I.FORMATS)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
