"""Queries of the review rules: runs and their steps, answers and solutions, scanned pages, boxes, front matter.

Documents carry cases where the tables hold no such subject; orders, line items and customers elsewhere.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import review as R
from ..functions.text import CIRCLED
from .gates import exploded, union
from .inline import OWN, after, carried, carry, some_after, values
from .registry import query

RUNS = [
    (1, True, 1, "", "③", "정리"),
    (2, True, 3, "", "12", None),
    (3, False, 2, "429 from host", None, None),
    (4, False, 1, "RESOURCE_EXHAUSTED: quota", None, None),
    (5, False, 4, "OPENAI_API_KEY 미설정", None, None),
    (6, False, 1, "broken", None, None),
    (7, True, 1, "", " ", "약 3 정도"),
    (8, True, 1, "", "값은 확인 필요", ""),
    (9, False, 1, "GEMINI_API_KEY 미설정 / Quota", None, None),
]
STEPS = [
    (1, 1, "식을 세우면", "x+1=2"),
    (1, 2, "풀면", "x=1"),
    (1, 3, "따라서 ③", ""),
    (2, 1, "값은 \\frac{1}{2}", ""),
    (2, 2, "보기 ②와 같다", ""),
    (7, 1, "가", ""),
    (7, 2, "나", ""),
    (7, 3, "\\pits", "\\pi"),
    (8, 1, "다 ④", "y=1"),
]
GATHERED = f"""(SELECT r.*, coalesce(n, 0) AS n, coalesce(bare, 0) AS bare, coalesce(raw, false) AS raw, coalesce(shown, false) AS shown, concat_ws(chr(10), answer, summary, coalesce(joined, '')) AS full_text
    FROM {carried(RUNS, "id, ok, attempts, errors, answer, summary", summary=after("summary"))[:-1]}r LEFT JOIN (SELECT id, count(*) AS n, sum(CASE WHEN trim(equation) = '' THEN 1 ELSE 0 END) AS bare, bool_or(regexp_matches(text, '{R.RAW_LATEX}')) AS raw,
    bool_or(regexp_matches(text || equation, '{R.ANY_CHOICE}')) AS shown, string_agg(text || ' ' || equation, chr(10) ORDER BY no) AS joined FROM {carried(STEPS, "id, no, text, equation", text=after("text"))} GROUP BY id) s USING (id))"""


def runs(read):
    """The runs with their steps in order; a run without steps has an empty array."""
    steps = carry(read, STEPS, "id int, no int, text string, equation string", text=after("text")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "text", "equation"))).alias("steps"))
    rows = carry(read, RUNS, "id int, ok boolean, attempts int, errors string, answer string, summary string", summary=after("summary")).join(steps, "id", "left")
    return rows.withColumn("steps", F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)))


@query(union(GATHERED, {
    "quota": f"NOT ok AND regexp_matches(errors, '{R.QUOTA}')",
    "no_key": f"NOT ok AND NOT regexp_matches(errors, '{R.QUOTA}') AND regexp_matches(errors, '{R.NO_KEY}')",
    "no_second_key": f"NOT ok AND NOT regexp_matches(errors, '{R.QUOTA}') AND regexp_matches(errors, '{R.NO_SECOND_KEY}')",
    "rate_limit": f"NOT ok AND NOT regexp_matches(errors, '{R.QUOTA}|미설정') AND regexp_matches(errors, '{R.RATE}')",
    "failed": "NOT ok",
    "retried": "ok AND attempts > 1",
    "few_steps": "ok AND n < 3",
    "approximate": f"ok AND regexp_matches(full_text, '{R.APPROXIMATE}')",
    "raw_latex": "ok AND raw",
    "choice_notation": f"ok AND shown AND NOT regexp_matches(answer, '{R.ANY_CHOICE}')",
    "no_answer": "ok AND trim(answer) = ''",
}))
def run_review(read):
    return exploded(runs(read), R.run_issues(*[F.col(c) for c in ("ok", "attempts", "errors", "answer", "summary", "steps")]))


@query(union(GATHERED, {
    "no_json": "NOT ok",
    "few_steps": "ok AND n < 2",
    "unreadable": f"ok AND regexp_matches(answer, '{R.UNREADABLE}')",
    "no_equations": "ok AND bare / greatest(n, 1) > 0.7",
}))
def reading_review(read):
    return exploded(runs(read), R.reading_issues(F.col("answer"), F.when(F.col("ok"), F.col("steps"))))


ANSWERED = [
    (1, "[정답] ③\n[해설] 보기 중에서 고르면 따라서 ②"),
    (2, "앞글 [정답] 2\n[해설] 따라서 2번."),
    (3, "[정답] 12\n[해설] 선택지를 보면 그러므로 ④"),
    (4, "[정답] ⑤\n[해설] ① 1 ② 2 중에서 계산한다"),
    (5, "[정답] 3\n[해설] 계산하면 끝"),
    (6, "[정답]\n[해설] 보기"),
    (7, "[정답] 1/2\n[해설] 객관식이지만 값을 썼다"),
    (8, "해설뿐"),
    (9, "[정답] ①\n[해설] 그러므로 보기 4 를 고른다"),
    (10, "[정답] \\sqrt{2} 3\n[해설] 보기에서\n정답은 ①"),
]
PARTS = f"""(SELECT id, a, s, translate(a, '{CIRCLED}', '12345') AS k, regexp_matches(substr(s, 1, 1200), '{R.CHOICES_NAMED}') OR regexp_matches(substr(s, 1, 900), '{R.CHOICES_SHOWN}') AS named,
    CASE WHEN regexp_extract(s, '{R.CLOSED_CIRCLED}', 3) <> '' THEN translate(regexp_extract(s, '{R.CLOSED_CIRCLED}', 3), '{CIRCLED}', '12345') ELSE regexp_extract(s, '{R.CLOSED_DIGIT}', 4) END AS closed
    FROM (SELECT id, trim(regexp_extract(t, '{R.ANSWER}', 1)) AS a, regexp_extract(t, '{R.SOLUTION}', 1) AS s FROM {carried(ANSWERED, 'id, t', t=after('t'))}) WHERE a <> '' AND trim(s) <> '')"""


@query(union(PARTS, {
    "choice_differs": "regexp_full_match(k, '[1-5]') AND closed <> '' AND closed <> k",
    "computed_answer": f"named AND regexp_matches(a, '[0-9]') AND NOT regexp_full_match(k, '[1-5]') AND (contains(a, '/') OR coalesce(TRY_CAST(replace(a, ' ', '') AS BIGINT) > 5, false) OR regexp_matches(a, '{R.COMPUTED}'))",
    "no_closing_choice": "named AND regexp_full_match(k, '[1-5]') AND closed = ''",
}))
def choice_review(read):
    return exploded(carry(read, ANSWERED, "id int, t string", t=after("t")), R.choice_issues(F.col("t")))


QUESTIONS = [(1, "삼각형의 넓이를 구하시오."), (2, "두 그래프의 교점의 x좌표의 합"), (3, "확률을 구하시오"), (4, ""), (5, "0 ≤ x 에서 서로 다른 실근"), (6, "그림과 같이 반지름이 2 인 부채꼴")]
SCORE = " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {w} ELSE 0 END" for _, w, p in R.DIAGRAM)
REASONS = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{name}' END" for name, _, p in R.DIAGRAM)


@query(f"SELECT id, score, score >= {R.DIAGRAM_FROM} AS wanted, reasons FROM (SELECT id, {SCORE} AS score, concat_ws(',', {REASONS}) AS reasons FROM {carried(QUESTIONS, 'id, t', t=after('t'))})")
def diagram_need(read):
    rows = carry(read, QUESTIONS, "id int, t string", t=after("t")).select("id", R.diagram_need(F.col("t")).alias("d"))
    return rows.select("id", "d.score", (F.col("d.score") >= R.DIAGRAM_FROM).alias("wanted"), F.array_join("d.reasons", ",").alias("reasons"))


SOLUTIONS = [
    (1, "killer", "[정답] 3\n[해설] 로피탈 정리를 쓰면 약 3 이다"),
    (2, "easy", "[정답] ②\n[해설] 어림하면 된다"),
    (3, "easy", "[정답] 1\n[해설] " + "가" * 1801),
    (4, "balanced", "[정답] 1\n[해설] " + "가" * 1801),
    (5, "easy", "[정답] 1\n[해설]\n" + "\n".join(f"{i}. 줄" for i in range(1, 14))),
    (6, "killer", "[정답] 1\n[해설]\n" + "\n".join(f"{i}. 줄" for i in range(1, 14))),
    (7, "easy", "[정답] 1\n[해설] [방법 1] [방법 2] " + "나" * 1900),
    (8, "other", "[해설] curl 과 ∮ 와 Jacobian, 대략 그러므로 정답"),
]
LENGTHS = f"""(SELECT *, CASE WHEN n >= 3 AND numbered >= 2 AND numbered / n >= 0.35 THEN n > CASE profile WHEN 'killer' THEN 26 WHEN 'easy' THEN 12 ELSE 16 END
    ELSE length(s) > CASE profile WHEN 'killer' THEN 5500 WHEN 'easy' THEN 1800 ELSE 2800 END END AS lengthy, len(regexp_extract_all(s, '\\[방법\\s*\\d+\\]')) AS methods,
    regexp_matches(concat_ws(chr(10), a, s), '{R.ESTIMATED}') AS estimated, regexp_matches(a, '{R.EXACT}') OR regexp_matches(s, '{R.EXACT_END}') AS exact FROM
    (SELECT *, len(filled) AS n, len(list_filter(filled, lambda x: regexp_matches(x, '^\\d+\\.\\s'))) AS numbered FROM (SELECT *, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS filled FROM
    (SELECT id, t, profile, trim(regexp_extract(t, '{R.ANSWER}', 1)) AS a, trim(regexp_extract(t, '{R.SOLUTION}', 1)) AS s FROM {carried(SOLUTIONS, 'id, profile, t', t=after('t'))}))))"""


@query(union(LENGTHS, {name: f"regexp_matches(t, '{p.replace("'", "''")}')" for name, p in R.SCOPE} | {
    "estimate_beside_exact": "estimated AND exact",
    "estimate": "estimated AND NOT exact",
    "too_long": "methods <= 1 AND lengthy",
}))
def solution_review(read):
    rows = carry(read, SOLUTIONS, "id int, profile string, t string", t=after("t"))
    return exploded(rows, F.concat(R.scope_issues(F.col("t")), R.length_issues(F.col("t"), F.col("profile"))))


SCANS = [(1, "짧다"), (2, "[문항 1] " + "가" * 120), (3, "나" * 120 + " 풀이 3. 값"), (4, "3. " + "다" * 120 + " 정답 [해설 3]"), (5, "라" * 210 + " 7) 해설"), (6, "")]


@query(union(carried(SCANS, "id, t", t=some_after("t")), {
    "short": "length(t) < 100",
    "no_item": f"NOT regexp_matches(t, '{R.ITEM}') AND NOT regexp_matches(substr(t, 1, 200), '\\d+[.)]')",
    "no_solution_mark": f"regexp_matches(t, '{R.SOLVED_WORD}') AND NOT regexp_matches(t, '{R.SOLVED}')",
}))
def scan_review(read):
    return exploded(carry(read, SCANS, "id int, t string", t=some_after("t")), R.scan_issues(F.col("t")))


MESSAGES = [(1, "Unsupported token \\foo"), (2, "Tree is invalid"), (3, "boom"), (4, None), (5, "unsupported tree")]


@query(f"SELECT id, CASE WHEN contains(lower(t), 'unsupported') THEN 'unsupported_token' WHEN contains(lower(t), 'tree') OR contains(lower(t), 'invalid') THEN 'tree_invalid' ELSE 'parse_error' END AS kind FROM {carried(MESSAGES, 'id, t', t=after('t'))}")
def formula_errors(read):
    return carry(read, MESSAGES, "id int, t string", t=after("t")).select("id", R.formula_error(F.col("t")).alias("kind"))


#: The models of a profile, by host; other profiles take that of balanced.
MODELS = [("killer", "gemini-2.5-pro", "gpt-4o"), ("easy", "gemini-2.0-flash-lite", "gpt-4o-mini"), ("balanced", "gemini-2.0-flash", "gpt-4o-mini")]


@query(f"""SELECT o_orderkey, coalesce(m.gemini, b.gemini) AS gemini, coalesce(m.openai, b.openai) AS openai FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'killer' WHEN '5-LOW' THEN 'easy' WHEN '3-MEDIUM' THEN 'other' ELSE 'balanced' END AS profile FROM orders)
    LEFT JOIN {values(MODELS, 'profile, gemini, openai').replace('AS t(', 'AS m(')} USING (profile) CROSS JOIN (SELECT gemini, openai FROM {values(MODELS, 'profile, gemini, openai')} WHERE profile = 'balanced') b""")
def routed_models(read):
    """The models that an order's profile is sent to, by a map within the expression."""
    priority = F.col("o_orderpriority")
    profile = F.when(priority == "1-URGENT", "killer").when(priority == "5-LOW", "easy").when(priority == "3-MEDIUM", "other").otherwise("balanced")
    pick = lambda at: F.coalesce(F.create_map(*[F.lit(x) for m in MODELS for x in (m[0], m[at])])[profile], F.lit(MODELS[2][at]))
    return read("orders").select("o_orderkey", pick(1).alias("gemini"), pick(2).alias("openai"))


@query("""SELECT o_orderkey, figures > 0 AS extra_picture, CASE WHEN figures > 0 THEN 'inline_with_problem_images' ELSE 'after_explanation' END AS placement
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS figures FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey""".replace("figures > 0", "coalesce(figures, 0) > 0"))
def picture_placement(read):
    """Where a solution's picture goes: beside those of the problem if it has figures (returned line items)."""
    figures = read("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("has")).distinct()
    has = F.coalesce("has", F.lit(False))
    placed = F.when(has, "inline_with_problem_images").otherwise("after_explanation")
    return read("orders").join(figures, "o_orderkey", "left").select("o_orderkey", has.alias("extra_picture"), placed.alias("placement"))


@query("""SELECT l_orderkey, string_agg(status || ':' || n, ' ' ORDER BY status) AS summary FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def status_summary(read):
    """How often each status occurs in an order, as one text by name."""
    counts = read("lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("status")).agg(F.count("*").alias("n"))
    named = F.array_sort(F.collect_list(F.concat_ws(":", "status", "n")))
    return counts.groupBy("l_orderkey").agg(F.array_join(named, " ").alias("summary"))


@query("""SELECT c_custkey FROM customer WHERE contains(lower(to_json({'name': c_name, 'segment': c_mktsegment, 'nation': c_nationkey})), '"segment":"build') """)
def search_as_json(read):
    """Rows whose JSON text holds a pattern, in any case."""
    text = F.lower(F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))))
    return read("customer").where(text.contains('"segment":"build')).select("c_custkey")


BOXES = [
    (1, '{"nx": 0.1, "ny": 0.2, "nw": 0.3, "nh": 0.4, "confidence": 0.9}'),
    (2, 'box: {"nx": 0.5, "ny": -1, "nw": 0.75, "nh": 2} end'),
    (3, '{"nx": 0.1, "ny": 0.2, "nw": 0.03, "nh": 0.4}'),
    (4, '{"nx": 1, "ny": 0, "nw": 0.5, "nh": 0.5}'),
    (5, '{"nx": "0.25", "ny": 0, "nw": 0.5, "nh": 0.5, "confidence": "high"}'),
    (6, "none"),
    (7, '{"nx": 0.1, "ny": 0.2, "nw": 0.3}'),
    (8, None),
    (9, "{broken"),
]


@query(f"""SELECT id, nx, ny, nw, nh, sure AS confidence FROM (SELECT id, nx, ny, w, h, CASE WHEN nx + w > 1 THEN 1 - nx ELSE w END AS nw, CASE WHEN ny + h > 1 THEN 1 - ny ELSE h END AS nh, sure FROM
    (SELECT id, {", ".join(f"greatest(0.0, least(1.0, TRY_CAST(json_extract_string(j, '$.{k}') AS DOUBLE))) AS {a}" for k, a in (("nx", "nx"), ("ny", "ny"), ("nw", "w"), ("nh", "h")))},
    greatest(0.0, least(1.0, coalesce(TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0.5))) AS sure, TRY_CAST(json_extract_string(j, '$.nh') AS DOUBLE) IS NOT NULL AS whole
    FROM (SELECT id, CASE WHEN json_valid(regexp_extract(t, '(?s)\\{{.*\\}}')) THEN regexp_extract(t, '(?s)\\{{.*\\}}') END AS j FROM {carried(BOXES, 'id, t', t=after('t'))})) WHERE whole)
    WHERE w >= 0.06 AND h >= 0.06 AND nw >= 0.06 AND nh >= 0.06""")
def parsed_boxes(read):
    rows = carry(read, BOXES, "id int, t string", t=after("t")).select("id", R.box(F.col("t")).alias("box"))
    return rows.where("box IS NOT NULL").select("id", "box.*")


SHARED = {c: f"{OWN} || c.{c}" for c in ("a", "b")}
PAIRS = [(1, "abc", "abc"), (2, "abc", "abd"), (3, "", "x"), (4, "가나다라", "가나"), (5, "same", ""), (6, "", ""), (7, "x" * 50 + "\ny" + "z" * 50, "x" * 50 + "\nw" + "z" * 50)]
AT = "coalesce(list_filter(range(0, CAST(greatest(length(a), length(b)) AS BIGINT)), lambda i: substr(a, i + 1, 1) <> substr(b, i + 1, 1))[1], -1)"


@query(f"""SELECT id, place, CASE WHEN place < 0 THEN '' ELSE replace(substr(a, greatest(place - 36, 0) + 1, place + 36 - greatest(place - 36, 0)), chr(10), '\\n') END AS here FROM (SELECT id, a, {AT} AS place FROM {carried(PAIRS, 'id, a, b', **SHARED)})""")
def text_differences(read):
    """Where two texts first differ, and what stands there in the first."""
    rows = carry(read, PAIRS, "id int, a string, b string", **SHARED).withColumn("place", R.first_difference(F.col("a"), F.col("b")))
    return rows.select("id", "place", R.excerpt(F.col("a"), F.col("place")).alias("here"))


HEADS = [
    (1, "---\ntype: books/Algebra.pdf\nsourceImage: a/b.pdf#page=3\n---\nbody.pdf"),
    (2, "---\ntype: plain\n---\nx"),
    (3, "no front matter.pdf"),
    (4, "---\nsourceImage: c.pdf#page=4---\nx"),
]


@query(f"""SELECT id, CASE WHEN starts_with(t, '---') AND len(p) >= 3 AND new <> p[2] THEN '---' || chr(10) || rtrim(new, chr(10)) || chr(10) || '---' || chr(10) || array_to_string(p[3:], '---') ELSE t END AS patched, regexp_replace(t, '(#page=\\d+)---', '\\1' || chr(10) || '---', 'g') AS repaired FROM
    (SELECT *, array_to_string(list_transform(string_split(p[2], chr(10)), lambda x: CASE WHEN starts_with(x, 'sourceImage:') THEN regexp_replace(x, '([^/]+)\\.pdf(#|/|$)', '\\1\\2', 'g') ELSE regexp_replace(x, '^type: (.*/)?([^/]+)\\.pdf$', 'type: \\2') END), chr(10)) AS new
    FROM (SELECT id, t, string_split(t, '---') AS p FROM {carried(HEADS, 'id, t', t=after('t'))}))""")
def front_matter_patched(read):
    t = F.col("t")
    return carry(read, HEADS, "id int, t string", t=after("t")).select("id", R.patched_front_matter(t).alias("patched"), R.joined_front_matter_repaired(t).alias("repaired"))


STYLE, SUFFIX = 200, "… (cut)"


@query(f"""SELECT doc_id, md5(substr(t, 1, 1500)) AS cleaned, md5(CASE WHEN length(t) <= {STYLE} THEN t ELSE regexp_replace(substr(t, 1, {STYLE}), '[ \\t\\n\\r]+\\z', '') || '{SUFFIX}' END) AS styled
    FROM (SELECT doc_id, replace(replace(text, chr(1), ''), chr(2), '') AS t FROM documents)""")
def prompt_texts(read):
    """Digests of each document as a prompt holds it: without marks, and cut to its style."""
    t = F.col("text")
    return read("documents").select("doc_id", F.md5(F.substring(F.translate(t, "\u0001\u0002", ""), 1, 1500)).alias("cleaned"), F.md5(R.styled(t, STYLE, SUFFIX)).alias("styled"))


FINDINGS = [(1, "pairing", "적중률 40.5% (12 건)"), (2, "missing", "누락 7건"), (3, "other", "없음"), (4, "pairing", "7 %"), (5, "missing", None)]


@query(f"SELECT id, TRY_CAST(nullif(regexp_extract(t, '(\\d+(\\.\\d+)?)\\s*%', 1), '') AS DOUBLE) / 100 AS rate, CAST(coalesce(nullif(regexp_extract(t, '(\\d+)\\s*건', 1), ''), '0') AS BIGINT) AS n FROM {carried(FINDINGS, 'id, area, t', t=after('t'))}")
def finding_numbers(read):
    """The first percentage of a finding as a share, and its first number of cases (none: 0)."""
    part = lambda p: F.nullif(F.regexp_extract("t", p, 1), F.lit(""))
    rate, n = part(r"(\d+(\.\d+)?)\s*%").cast("double") / 100, F.coalesce(part(r"(\d+)\s*건").cast("long"), F.lit(0))
    return carry(read, FINDINGS, "id int, area string, t string", t=after("t")).select("id", rate.alias("rate"), n.cast("long").alias("n"))


BODIES = [(1, 7, "7) [정답] 3\n글\n8) [정답] 4"), (2, 7, "8. [정답] 4\n 9 ) 정답]"), (3, 7, "$7) [정답] 1\n본문 8) [정답]"), (4, 7, ""), (5, 1, "1.[정답]\n\\( 2) [정답]")]


@query(f"""SELECT id, count(n) AS headers, count(n) FILTER (WHERE n <> owner) AS loose, CASE WHEN bool_or(coalesce(n = owner, false)) THEN count(n) FILTER (WHERE n <> owner) ELSE 0 END AS strict FROM
    (SELECT id, owner, CAST(nullif(regexp_extract(trim(regexp_replace(trim(regexp_replace(trim(x), '^\\$+\\s*', '')), '^\\\\\\(\\s*', '')), '{R.OWNED_ANSWER}', 1), '') AS INT) AS n FROM (SELECT id, owner, unnest(string_split(t, chr(10))) AS x FROM {carried(BODIES, 'id, owner, t', t=after('t'))})) GROUP BY id, owner""")
def foreign_answers(read):
    """Answer headers of a body, those of other owners, and the latter where the owner has a header too."""
    rows = carry(read, BODIES, "id int, owner int, t string", t=after("t")).select("id", R.foreign_answers(F.col("t"), F.col("owner")).alias("f"))
    return rows.select("id", *[F.col(f"f.{c}").cast("long").alias(c) for c in ("headers", "loose", "strict")])


MARKED = [(1, "값 \u0001 x+1 \u0001 와\n \u0001y\u0001 끝"), (2, "\u0002IMG\u0002 &lt;b&gt; &amp;lt; &quot;q&apos;"), (3, " 없음 ")]


@query(f"""SELECT id, trim(regexp_replace(replace(regexp_replace(t, '\u0001([^\u0001]*)\u0001', ' $$\\1$$ ', 'g'), '\u0002IMG\u0002', ' [그림] '), '\\s+', ' ', 'g')) AS cleaned, array_to_string(list_transform(regexp_extract_all(t, '\u0001([^\u0001]*)\u0001', 1), lambda x: trim(x)), '|') AS equations,
    replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&apos;', '''') AS decoded FROM {carried(MARKED, 'id, t', t=after('t'))}""")
def marked_texts(read):
    cleaned, equations = R.marked_equations(F.col("t"))
    return carry(read, MARKED, "id int, t string", t=after("t")).select("id", cleaned.alias("cleaned"), F.array_join(equations, "|").alias("equations"), R.decoded(F.col("t")).alias("decoded"))
