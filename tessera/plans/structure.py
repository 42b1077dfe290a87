"""Queries of the structure rules over solutions that documents carry, and of small predicates and picture headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import structure as S
from .gates import exploded, union
from .inline import after, carried, carry
from .registry import query

SOLUTIONS = [
    (1, "[정답] ③\n[해설] 식을 세우면 다음과 같고 따라서 정답은 ③ 이다. 이것으로 풀이를 마친다 ("),
    (2, "머리말 [정답] 2\n[해설] 짧다"),
    (3, "[정답]\n[해설] 첫째 정답은 ② 이고 넉넉히 길게 써 본다 그래서 길다\n[정답] 12\n[해설] 다음 문제 를 본다"),
    (4, "해설도 정답도 없다 $x"),
    (5, "[빠른 정답]\n①\n[해설]\n이어서 문제 하나 더\n4번 문항 은 이렇다\n2) [정답] ②\n3. [정답] 5"),
    (6, "[정답] ④\n[해설] 여기서 정답: ⑤ 이므로 [방법 1] 가\n [방법 2] 나 \\frac{1}{2} a^{2}\n```python\nprint(1)\n```"),
    (7, "[해설] 먼저 나온다 해설 생성 버튼을 누르면 된다\n[빠른 정답] $x$ \\alpha"),
    (8, "서론이 마흔 글자보다 길어야 하므로 이렇게 길게 써 두는데 아직도 모자라서 조금 더 쓴다\n[문항 1] 가 [문항 2] 나 [문항 1] 다 $$\\sqrt{2}$$"),
    (9, "\n![p](a.png)\n9) [문제]\n식\n9) [빠른 정답]\n①\n[해설]\n끝 ```python\n\n``` \\( x \\) 와 \\[ y = 1. \\]"),
    (10, "1) [문제]\n[해설]\n가\n1) [빠른 정답]\n2\n![그래프](f/문항3_그래프.png)"),
]
SCHEMA = "id int, t string"
ROWS = carried(SOLUTIONS, "id, t", t=after("t"))
SPACE = "[ \\t\\n\\f\\r\\v]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+\\z', '', 'g')"


def solutions(read):
    return carry(read, SOLUTIONS, SCHEMA, t=after("t"))


BODIES = f"(SELECT id, t, {strip('regexp_extract(t, ' + chr(39) + '(?is)' + chr(92) + '[해설' + chr(92) + ']' + chr(92) + 's*(.*)' + chr(39) + ', 1)')} AS e FROM {ROWS})"


@query(f"SELECT id, length(e) < 50 OR regexp_matches(e, '[,:+\\-*/=]\\z') OR len(regexp_extract_all(e, '[(\\[{{]')) > len(regexp_extract_all(e, '[)\\]}}]')) AS truncated FROM {BODIES}")
def truncated_solutions(read):
    """Solutions that seem cut off."""
    return solutions(read).select("id", S.truncated(F.col("t")).alias("truncated"))


@query(union(f"(SELECT * FROM {BODIES} WHERE e <> '')", {name: f"regexp_matches(e, '{p}')" for name, p in S.BLEED} | {"many_answers": "len(regexp_extract_all(t, '\\[정답\\]')) > 1"}))
def bled_solutions(read):
    """Signs of other items in a solution."""
    return exploded(solutions(read), S.bleed_issues(F.col("t")))


OWN = f"(SELECT id, o, {strip('regexp_extract(o, ' + chr(39) + '(?s)' + chr(92) + '[해설' + chr(92) + ']' + chr(92) + 's*(.*)' + chr(39) + ', 1)')} AS e, len(regexp_extract_all(o, '\\[해설\\]')) AS n, trim(regexp_extract(o, '\\[정답\\]\\s*([^\\n\\r]*)', 1)) AS a FROM (SELECT id, CASE WHEN contains(t, '[정답]') THEN substr(t, strpos(t, '[정답]')) ELSE t END AS o FROM (SELECT id, {strip('t')} AS t FROM {ROWS})))"


@query(union(OWN, {"no_leading_answer": "NOT starts_with(o, '[정답]')", "no_explanation": "n = 0", "many_explanations": "n > 1", "no_answer": "contains(o, '[정답]') AND a = ''", "short_explanation": "n > 0 AND length(e) < 35"}))
def format_issues(read):
    """The form of a solution: its answer first, one explanation of some length."""
    return exploded(solutions(read), S.format_issues(F.col("t")))


MERGED = f"(SELECT id, t, regexp_extract_all(t, '\\[문항\\s*(\\d+)\\]', 1) AS l, {strip('regexp_split_to_array(t, ' + chr(39) + chr(92) + '[문항' + chr(92) + 's*' + chr(92) + 'd+' + chr(92) + ']' + chr(39) + ')[1]')} AS i FROM (SELECT id, {strip('t')} AS t FROM {ROWS}))"


@query(union(MERGED, {"empty": "t = ''", "odd_dollars": "len(regexp_extract_all(t, '\\$')) % 2 = 1", "long_intro": "len(l) > 0 AND length(i) > 40", "repeated_item": "len(l) > len(list_distinct(l))"}))
def merged_text_issues(read):
    """A merged text as a whole."""
    return exploded(solutions(read), S.merged_issues(F.col("t")))


CHUNK = f"""(SELECT *, regexp_matches(t, '\\[(?:빠른\\s*정답|정답)\\]') AS h, contains(t, '[해설]') AS b, coalesce(nullif(strpos(t, regexp_extract(t, '\\[(?:빠른\\s*정답|정답)\\]')), 0), 0) AS p, strpos(t, '[해설]') AS q,
    {strip("coalesce(nullif(regexp_extract(t, '" + chr(92) + "[(?:빠른" + chr(92) + "s*정답|정답)" + chr(92) + "]" + chr(92) + "s*" + chr(92) + "n" + chr(92) + "s*([^" + chr(92) + "n" + chr(92) + "r]+)', 1), ''), regexp_extract(t, '" + chr(92) + "[(?:빠른" + chr(92) + "s*정답|정답)" + chr(92) + "]" + chr(92) + "s*([^" + chr(92) + "n" + chr(92) + "r]+)', 1))")} AS a FROM {BODIES})"""


@query(union(CHUNK, {
    "no_answer_header": "NOT h",
    "no_explanation": "NOT b",
    "wrong_order": "h AND b AND q < p",
    "plain_answer_header": "NOT regexp_matches(t, '\\[빠른\\s*정답\\]') AND contains(t, '[정답]')",
    "empty_answer": "h AND a = ''",
    "formula_in_answer": "regexp_matches(a, '(?i)\\\\[a-z]+') OR regexp_matches(a, '\\$[^$]+\\$')",
    "short_explanation": "b AND length(e) < 20",
    "interface_text": f"regexp_matches(e, '{S.LEFT_OVER}')",
}))
def merged_chunk_issues(read):
    """An item of a merged text: its headers, answer and explanation."""
    return exploded(solutions(read), S.chunk_issues(F.col("t")))


@query()
def strict_headers(read):
    """An item's numbered headers, each on a line of its own and in order; held against a loop by the tests."""
    return exploded(solutions(read), S.header_issues(F.col("t")))


@query()
def answer_conflicts(read):
    """Items whose explanation declares another choice than their answer; held against a loop by the tests."""
    return solutions(read).select("id", S.answer_conflicts(F.col("t")).alias("c")).select("id", "c.*")


OUTSIDE = "regexp_replace(regexp_replace(t, '(?s)\\$\\$.+?\\$\\$', '', 'g'), '\\$[^$\\n]+\\$', '', 'g')"
RAW = " OR ".join(f"regexp_matches({OUTSIDE}, '{p.replace('(?![A-Za-z0-9_])', '([^A-Za-z0-9_]|' + chr(92) + 'z)')}')" for p in S.RAW_COMMANDS)


@query(f"""SELECT id, CASE WHEN rate >= 0.5 THEN 'error' WHEN n > 0 THEN 'warn' ELSE 'ok' END AS severity, array_to_string(list_filter([CASE WHEN rate >= 0.5 THEN 'fallback_half' END, CASE WHEN rate >= 0.3 AND rate < 0.5 THEN 'fallback_third' END, CASE WHEN raw THEN 'raw_command' END, CASE WHEN long THEN 'long_equation' END], lambda x: x IS NOT NULL), ',') AS issues
FROM (SELECT *, (CASE WHEN rate >= 0.3 THEN 1 ELSE 0 END + CASE WHEN raw THEN 1 ELSE 0 END + CASE WHEN long THEN 1 ELSE 0 END) AS n FROM (SELECT id, CASE WHEN id % 7 > 0 THEN (id % 5) / CAST(id % 7 AS DOUBLE) END AS rate, {RAW} AS raw, len(list_filter(string_split(t, chr(10)), lambda x: length(x) > 150)) > 0 AS long FROM {ROWS}))""")
def solution_consistency(read):
    """Severity and issues of a solution, its lines taken for equations."""
    rows = solutions(read).select("id", S.consistency(F.col("t"), F.split("t", "\n"), F.col("id") % 7, F.col("id") % 5).alias("c"))
    return rows.select("id", "c.severity", F.array_join("c.issues", ",").alias("issues"))


@query()
def method_blocks(read):
    """Methods of a solution and what stands before them; held against a loop by the tests."""
    return solutions(read).select("id", S.method_blocks(F.col("t")).alias("m")).select("id", "m.intro", "m.methods")


@query(f"""SELECT id, array_to_string(list_filter(list_transform(regexp_extract_all(t, '(?is)```python\\s*(.*?)```', 1), lambda x: {strip('x')}), lambda x: x <> ''), '|') AS blocks,
regexp_replace(regexp_replace(regexp_replace(t, '(?is)```python\\s*(.*?)```', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\s+\\z', '') AS rest FROM {ROWS}""")
def python_blocks(read):
    return solutions(read).select("id", S.python_blocks(F.col("t")).alias("p")).select("id", F.array_join("p.blocks", "|").alias("blocks"), "p.rest")


@query(f"SELECT id, regexp_matches(t, '{S.GRAPH_FIGURE}') AS has_graph, regexp_matches(regexp_replace(t, '^[\\x{{feff}}\\s]+', ''), '(?i)\\A\\[(문제|정답)\\]') AND length(e) >= 40 AS is_solution FROM {BODIES}")
def solution_files(read):
    """Whether a text has a graph already, and whether it is a solution at all."""
    return solutions(read).select("id", F.col("t").rlike(S.GRAPH_FIGURE).alias("has_graph"), S.solution_file(F.col("t")).alias("is_solution"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type = 'error' ELSE false END AS truncated, CASE WHEN event_id % 4 = 0 OR value >= 100 THEN nullif(trim(coalesce(event_type, '')), '') END AS text,
CASE WHEN event_type IN ('gemini', 'openai') THEN event_type ELSE 'gemini' END AS model, CASE WHEN value > 0 AND value <= 20 THEN CAST(floor(value) AS BIGINT) ELSE 3 END AS top_k, CASE WHEN value - 5 >= 0 AND value - 5 <= 10 THEN CAST(floor(value - 5) AS BIGINT) ELSE 2 END AS retries FROM events""")
def model_answers(read):
    """Answers cut off at the limit of tokens, texts of enough confidence, and options in their ranges, of events."""
    id_, kind, value = F.col("event_id"), F.col("event_type"), F.col("value")
    finish = F.when(kind == "error", "MAX_TOKENS").otherwise("STOP")
    json = F.when(id_ % 3 == 0, F.to_json(F.struct(F.array(F.struct(finish.alias("finishReason"))).alias("candidates")))).when(id_ % 3 == 1, kind)
    options = S.normal_options(kind, kind, value, value - 5)
    return read("events").select("event_id", S.response_truncated(json).alias("truncated"), S.confident_text(F.coalesce(kind, F.lit("")), F.when(id_ % 4 != 0, value), 100.0).alias("text"), options["model"].alias("model"), options["top_k"].alias("top_k"), options["retries"].alias("retries"))


KINDS = "CASE p_partkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' END"


@query(f"SELECT p_partkey, {KINDS} AS kind, CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 60000 END AS width, CASE WHEN p_partkey % 5 < 4 THEN CAST(p_size AS BIGINT) END AS height FROM part")
def picture_sizes(read):
    """Kind and size of pictures from the bytes of data URLs; the pictures' headers are made from parts."""
    key, size = (F.col("p_partkey") % 60_000).cast("long"), F.col("p_size").cast("long")
    big = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    little = lambda c, n: F.concat(*[F.substring(big(c, n), 2 * k + 1, 2) for k in reversed(range(n))])
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(key, 4), big(size, 4))
    jpg = F.concat(F.lit("FFD8FFE00004ABCDFFDB0003AA00FFC1000B08"), big(size, 2), big(key, 2), F.lit("0301220002110103"))
    gif = F.concat(F.lit("474946383961"), little(key, 2), little(size, 2), F.lit("00"))
    bmp = F.concat(F.lit("424D0000000000000000000000000000000000"[:36]), little(key, 4), little((1 << 32) - size, 4))
    other = F.lit("255044462D312E37")
    which = F.col("p_partkey") % 5
    raw = F.when(which == 0, png).when(which == 1, jpg).when(which == 2, gif).when(which == 3, bmp).otherwise(other)
    url = F.concat(F.lit("data:image/png;base64,"), F.base64(F.unhex(raw)))
    return read("part").select("p_partkey", S.raster(S.data_url(url)).alias("r")).select("p_partkey", "r.kind", "r.width", "r.height")
