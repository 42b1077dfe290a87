"""Queries of document functions over cases that documents carry; functions that SQL can't follow are held by the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exam as E
from ..functions import text as T
from .inline import after, carried, carry, some_after
from .registry import query


LABELLED = [(1, "서문 [문항 1] 가 나 [문항 2]  다\n[문항 3] "), (2, "없음"), (3, "[문항 10]라")]


@query(f"""SELECT id, label, trim(chunk, chr(10) || ' ') AS chunk FROM (SELECT id, regexp_extract(m, '\\[문항\\s*(\\d+)\\]', 1) AS label, regexp_replace(m, '^\\[문항\\s*\\d+\\]\\s*', '') AS chunk FROM
(SELECT id, unnest(regexp_extract_all(t, '\\[문항\\s*\\d+\\][^\\[]*')) AS m FROM {carried(LABELLED, 'id, t', t=after('t'))})) WHERE trim(chunk, chr(10) || ' ') <> ''""")
def labelled_chunks(read):
    return carry(read, LABELLED, "id int, t string", t=after("t")).select("id", F.inline(E.labelled_chunks(F.col("t"))))


CHOICES = [(1, "문제 ① 1 ② 2 ③ 3"), (2, " 하나 ① 만 "), (3, "①a②b"), (4, "없음")]


@query(f"""SELECT id, CASE WHEN n >= 2 THEN trim(p[1], chr(10) || ' ') ELSE trim(t, chr(10) || ' ') END AS stem, CASE WHEN n >= 2 THEN array_to_string(list_transform(p[2:], lambda x: trim(x, chr(10) || ' ')), '|') ELSE '' END AS choices
FROM (SELECT id, t, len(regexp_extract_all(t, '[①-⑩]')) AS n, regexp_split_to_array(t, '[①-⑩]') AS p FROM {carried(CHOICES, 'id, t', t=after('t'))})""")
def split_choices(read):
    rows = carry(read, CHOICES, "id int, t string", t=after("t")).select("id", E.choices(F.col("t")).alias("c"))
    return rows.select("id", "c.stem", F.array_join("c.choices", "|").alias("choices"))


IN_SOURCE = "coalesce(d.source, '') || '/' || c.s"
SOURCES = [("a/b/쎈_대수_문제.pdf",), ("x/마플 해설.pdf",), ("plain.pdf",), ("워크북_정답_미적분.hwp",), ("문제.pdf",), ("c/EBS-problem-2.pdf",)]
KEYWORDS = "문제|기출|워크북|problem|question|해설|정답|answer|solution"


@query(f"""SELECT s, CASE WHEN kind IS NOT NULL AND series <> '' THEN series END AS series, CASE WHEN series <> '' THEN kind END AS kind FROM (SELECT s, CASE WHEN regexp_matches(lower(n), '해설|정답|answer|solution') THEN 'solution' WHEN regexp_matches(lower(n), '문제|기출|워크북|problem|question') THEN 'problem' END AS kind,
trim(regexp_replace(regexp_replace(regexp_replace(n, '\\.[^.]+$', ''), '(?i)[_\\s-]?({KEYWORDS})[_\\s-]?', ' ', 'g'), '\\s+', ' ', 'g')) AS series FROM (SELECT s, string_split(s, '/')[-1] AS n FROM {carried(SOURCES, 's', s=IN_SOURCE)}))""")
def series_kinds(read):
    return carry(read, SOURCES, "s string", s=IN_SOURCE).select("s", E.series_and_kind(F.col("s")).alias("k")).select("s", "k.series", "k.kind")


KEYS = [(1, " 쎈 ", "a/b.pdf"), (2, " ", "a/b.pdf"), (3, None, "c")]


@query(f"SELECT id, coalesce(nullif(trim(p), ''), string_split(s, '/')[-1]) AS key FROM {carried(KEYS, 'id, p, s', s=IN_SOURCE)}")
def series_keys(read):
    return carry(read, KEYS, "id int, p string, s string", s=IN_SOURCE).select("id", E.series_key(F.col("p"), F.col("s")).alias("key"))


QUESTIONS = [("18번", "짧다"), ("3", "① 1 ② 2"), ("x", "① 1 ② 2"), ("9", "가" * 600), ("9", "나" * 360 + "증명"), ("", "극한 값"), ("9", "그냥 긴 말"), ("5", "다" * 230 + "①")]
NUMBER = "TRY_CAST(nullif(regexp_replace(no, '[^0-9]', '', 'g'), '') AS INTEGER)"


@query(f"""SELECT no, length(t) AS chars, CASE WHEN coalesce({NUMBER} >= 17, false) OR length(t) >= 600 OR (length(t) >= 350 AND regexp_matches(t, '{E.COMPLEX}')) THEN 'killer' WHEN coalesce({NUMBER} BETWEEN 1 AND 7, false) AND regexp_matches(t, '[{E.ALL_CIRCLED}]') AND length(t) < 220 THEN 'easy'
WHEN regexp_matches(t, '[{E.ALL_CIRCLED}]') AND length(t) < 150 THEN 'easy' WHEN regexp_matches(t, '{E.COMPLEX}') THEN 'killer' ELSE 'balanced' END AS profile FROM {carried(QUESTIONS, 'no, t', t=after('t'))}""")
def difficulty_profiles(read):
    return carry(read, QUESTIONS, "no string, t string", t=after("t")).select("no", F.length("t").cast("long").alias("chars"), E.difficulty(F.col("no"), F.col("t")).alias("profile"))


MODELS = [("gpt-4o", 1000), ("gemini-2.5-pro", 500), ("other", 2000), (None, 100)]


@query("SELECT model, round(chars * 1.7 / 1000 * CASE model " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in E.CENTS.items()) + f" ELSE 0.05 END, 6)::DOUBLE AS cents FROM {carried(MODELS, 'model, chars', chars='c.chars + d.n_chars')}")
def approximate_costs(read):
    return carry(read, MODELS, "model string, chars int", chars="c.chars + d.n_chars").select("model", F.round(E.cost_cents(F.col("model"), F.col("chars")), 6).alias("cents"))


NAMES = [("고2) 2학년 1학기 중간고사",), ("중 3) 3 학년 2 학기 기말고사 ",), ("2학년 1학기 중간고사",), ("고1) 짧다",), (None,), ('a/b:c*?"<>| d   e',)]


@query(f"SELECT t, coalesce(length(t) >= 10 AND regexp_matches(t, '^[중고]\\s*\\d\\s*\\)') AND regexp_matches(t, '\\d\\s*학년\\s*\\d\\s*학기') AND regexp_matches(t, '(중간고사|기말고사)\\s*$'), false) AS valid, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(t, '[\\\\/:*?\"<>|]', '_', 'g'), '\\s+', ' ', 'g')), 1, 80), ''), '-') AS safe FROM {carried(NAMES, 't', t=some_after('t'))}")
def exam_names(read):
    return carry(read, NAMES, "t string", t=some_after("t")).select("t", E.valid_exam_name(F.col("t")).alias("valid"), E.safe_name(F.col("t")).alias("safe"))


LINES = [("",), ("![a](b.png)",), ("[문항 3]",), ("3) [문제]",), ("[문제 2]",), ("2) [빠른 정답]",), ("[빠른정답]",), (" [해설] ",), ("본문",)]


@query("SELECT line, CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in E.LINE_KINDS) + f" ELSE 'other' END AS kind FROM {carried(LINES, 'line', line=some_after('line'))}")
def line_kinds(read):
    return carry(read, LINES, "line string", line=some_after("line")).select("line", E.line_kind(F.col("line")).alias("kind"))


WITH_ONE = "c.t || '|' || coalesce(d.lang, '') || '=' || d.doc_id"
EQUATIONS = [(1, "a = b = c"), (2, "no sign"), (3, "x= "), (4, " | "), (5, "x|y=2| ")]


@query(f"SELECT id, trim(string_split(t, '=')[-1]) AS right_side, coalesce(list_filter(string_split(t, '|'), lambda e: trim(e) <> '')[-1], t) AS last FROM {carried(EQUATIONS, 'id, t', t=WITH_ONE)}")
def last_equations(read):
    return carry(read, EQUATIONS, "id int, t string", t=WITH_ONE).select("id", E.last_right_side(F.col("t")).alias("right_side"), E.last_equation(F.split("t", r"\|"), F.col("t")).alias("last"))


WITH_PAGES = "c.r || ' ' || (d.doc_id % 12) || '-' || (d.doc_id % 9) || ',' || d.doc_id"
RANGES = [("1,3-5",), ("5-3 7",), ("9~12",), ("2–2, x",), ("0-1",), ("",)]


@query(f"""SELECT r, coalesce(array_to_string(list_sort(list_distinct(flatten(list(pages))::INTEGER[])), ','), '') AS pages FROM (SELECT r, CASE WHEN regexp_matches(p, '^\\d+(-\\d+)?$') THEN range(greatest(least(regexp_extract(p, '^(\\d+)', 1)::INT, regexp_extract(p, '(\\d+)$', 1)::INT), 1), least(greatest(regexp_extract(p, '^(\\d+)', 1)::INT, regexp_extract(p, '(\\d+)$', 1)::INT), 10) + 1) ELSE [] END AS pages
FROM (SELECT r, unnest(regexp_split_to_array(regexp_replace(r, '[~–]', '-', 'g'), '[,\\s]+')) AS p FROM {carried(RANGES, 'r', r=WITH_PAGES)})) GROUP BY 1""")
def page_ranges(read):
    return carry(read, RANGES, "r string", r=WITH_PAGES).select("r", F.array_join(T.page_numbers(F.col("r"), 10).cast("array<string>"), ",").alias("pages"))


MARKED = [
    (1, '■ 정답과 해설\n내용'),
    (2, '**3.** 다음 값'),
    (3, '예제 7 : 다음'),
    (4, '12. 다음 값'),
    (5, '[문항 1] 그대로 1.5'),
    (6, '■ 정답: ③'),
    (7, '[해설] 4 끝'),
    (8, '1.5 배'),
    (9, '가\n■ 해설\n나\n정답과 해설\n다\n풀이 및 정답\n'),
    (10, '해설\n라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라라\n풀이\n마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마마'),
]


@query()
def ocr_normalised(read):
    """Markers of scanned texts in their standard forms, and the rules that changed them."""
    rows = carry(read, MARKED, "id int, t string", t=after("t")).select("id", E.normalised(F.col("t")).alias("n"))
    return rows.select("id", "n.text", F.array_join("n.rules", ",").alias("rules"))


SIGNS = [
    (1, '₩frac{1}{2}'),
    (2, '＄x＄ ￦sqrt2'),
    (3, '#wfrac{1}2 #logx #log x'),
    (4, 'a\\cdot b \\cdots'),
]


@query()
def normalised_signs(read):
    return carry(read, SIGNS, "id int, t string", t=after("t")).select("id", E.source_normalised(F.col("t")).alias("after"))


LOOSE = [
    (1, '이것은 답이다. 따라서 끝이다.'),
    (2, '값은 3. 이제부터 한다'),
    (3, '식이 되고 그러므로 참'),
    (4, 'a\n\n\n\nb'),
    (5, '3.14 이다'),
]


@query()
def loosened_paragraphs(read):
    return carry(read, LOOSE, "id int, t string", t=after("t")).select("id", E.loosened(F.col("t")).alias("after"))


#: Documents' words as the parts of an equation.
EQUALITY = "'$$' || replace(translate(substr(d.text, 1, 400), '[]{}' || chr(10) || chr(13), '      '), ' ', ' = ') || '$$'"


@query()
def compacted_equalities(read):
    return carry(read, [(1, "")], "id int, t string", t=EQUALITY).select("id", E.compacted(F.col("t")).alias("after"))


ANSWERS = [
    (1, '③', ''),
    (2, '3번', ''),
    (3, '12', ''),
    (4, '서술형 답', ''),
    (5, '5', '과정을 쓰시오'),
    (6, 'x=2', '풀이 과정을 쓰시오'),
    (7, '이것은 아주 긴 답이고 여러 말을 하는 문장이다. 그래서 서른여섯 자를 넘는다', ''),
    (8, '②번 (값은 6이고 그 밖의 말이 매우 길게 이어진다. 그래도 고른 답이다)', ''),
]


@query()
def answer_kinds(read):
    return carry(read, ANSWERS, "id int, answer string, e string", e=some_after("e")).select("id", E.answer_kind(F.col("answer"), F.col("e")).alias("kind"))


HEADS = [
    (1, '[문항 12] x'),
    (2, '**3)** x'),
    (3, '유형 4'),
    (4, '5. 다음'),
    (5, '6번 문제'),
    (6, '[문항 120] 7번'),
    (7, '1.5 배'),
    (8, '[8] x'),
    (9, None),
]


@query()
def problem_numbers(read):
    return carry(read, HEADS, "id int, t string", t=after("t")).select("id", T.problem_number(F.col("t")).alias("no"))


@query()
def packed_paragraphs(read):
    """Chunks of whole paragraphs, of at most 1,500 letters; held against a loop by the tests."""
    return read("documents").select("doc_id", F.posexplode(E.packed_paragraphs(F.regexp_replace("text", "\n", "\n\n"))).alias("at", "chunk"))


@query("""SELECT doc_id, len(list_filter(l, lambda x, i: trim(x) <> '' OR i = 1 OR trim(l[i - 1]) <> '')) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def collapsed_blank_lines(read):
    lines = F.split("text", "\n")
    return read("documents").select("doc_id", F.size(E.one_blank_line(lines)).cast("long").alias("n"))


@query("SELECT doc_id, substr(trim(regexp_replace(text, '[\\s 　﻿]+', ' ', 'g')), 1, 200) AS snippet, text <> '' AS filled FROM documents")
def reference_snippets(read):
    return read("documents").select("doc_id", E.squeezed_snippet(F.col("text")).alias("snippet"), (F.col("text") != "").alias("filled"))
