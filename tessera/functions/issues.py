"""Row-quality rules as column expressions: each rule gives a code, and a text the array of its codes.

Positions are 1-based, 0 meaning absent.  Word edges are written as "no letter or digit of ASCII beside".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CIRCLED

# Header, phrase and concept patterns of the exam format.
PROBLEM, QUICK, EXPLANATION, LEGACY = r"(?i)\[문제(\s+\d+)?\]", r"\[빠른\s*정답\]", r"\[해설\]", r"\[정답\]"
BANNED = r"(풀 수 없|알 수 없|판독 불가|모르겠|추정됩니다|화질)"
CONCLUSION = r"정답은?\s*([①②③④⑤1-5])"
RESIDUE = r"(^|[^\\A-Za-z0-9_])(Leftrightarrow|Rightarrow|Leftarrow|quad|qquad|mapsto)([^A-Za-z0-9_]|$)"
MEMBERSHIP = r"(∈\s*[\[〔［]|\\in\s*\[)"
FIGURE, OWN_FIGURE = r"^\s*!\[[^\]]*\]\([^)]+\)\s*$", r"^\s*!\[\s*참고\s*도형"
PERIOD = r"^\$[^$\n]+\$\s*\.\s*$|^\$\$.*\$\$\s*\.\s*$|^\$\$.*[0-9)}]\s*\.\s*\$\$$"
TRAILING = r"(\$[^$\n]+\$|\$\$.*\$\$)\s*\.\s*$"
SHORTHAND = r"(?i)(^|[^A-Za-z0-9_])[sc]\s*=\s*\\?(sin|cos)([^A-Za-z0-9_].{0,119}?)?[^A-Za-z0-9_][sc]\s*=\s*\\?(sin|cos)([^A-Za-z0-9_]|$)"
IFF = r"(?i)(^|[^A-Za-z0-9_])iff([^A-Za-z0-9_]|$)"
CONCEPTS = [
    ("laplace", r"(?i)라플라스 변환|laplace transform"),
    ("fourier", r"(?i)푸리에 (급수|변환)|fourier"),
    ("taylor", r"(?i)테일러 급수|taylor series|맥클로린|maclaurin"),
    ("partial", r"(?i)편미분|partial derivative"),
    ("multiple", r"(?i)중적분|double integral|triple integral"),
    ("path", r"선적분|면적분|경로적분"),
    ("equation", r"(?i)미분방정식|differential equation"),
    ("eigen", r"(?i)고유값|고유벡터|eigenvalue|eigenvector"),
    ("determinant", r"(?i)행렬식|determinant"),
    ("complex", r"(?i)복소평면|복소해석|유수정리|cauchy"),
]


def codes(*rules: tuple[str, Column]) -> Column:
    """The codes of the rules (code, condition) that hold; a null condition does not."""
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules]))


def place(text: Column, pattern: str) -> Column:
    """Where the pattern first matches, or 0."""
    return F.coalesce(F.regexp_instr(text, F.lit(pattern)), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")


def any_line(text: Column, pattern: str) -> Column:
    """Whether a trimmed line that is no picture matches."""
    return F.exists(lines(text), lambda x: ~F.trim(x).startswith("![") & F.trim(x).rlike(pattern))


def choice(token: Column) -> Column:
    """The circled figure of a choice: the first circled one, else a figure 1 to 5 that stands alone, else the token."""
    t = F.trim(token)
    circled = F.regexp_extract(t, "([①②③④⑤])", 1)
    figure = F.regexp_extract(t, r"(^|[^A-Za-z0-9_])([1-5])([^A-Za-z0-9_]|$)", 2)
    return F.when(circled != "", circled).when(figure != "", F.translate(figure, "12345", CIRCLED)).otherwise(t)


def last_conclusion(text: Column) -> Column:
    """The last choice that a text concludes with, or null."""
    return F.try_element_at(F.transform(F.regexp_extract_all(text, F.lit(CONCLUSION), F.lit(1)), choice), F.lit(-1))


def content_issues(answer: Column, explanation: Column) -> Column:
    """Codes of a draft's explanation against its answer; length is taken after trimming."""
    text = F.trim(explanation)
    flat = F.regexp_replace(text, r"\s+", " ")
    last, own = last_conclusion(text), choice(answer)
    concept = F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p in CONCEPTS])
    return codes(
        ("E_CONTENT_SHORT", F.length(text) < 40),
        ("E_CONTENT_BANNED_PHRASE", text.rlike(BANNED)),
        ("E_ANSWER_MISMATCH", (last != own) & (own != "")),
        ("E_MATH_SHORTHAND_SUBSTITUTION", flat.rlike(SHORTHAND)),
        ("E_MATH_TRAILING_PERIOD", any_line(text, TRAILING)),
        ("E_IFF_TOKEN", text.rlike(IFF)),
        ("E_CURRICULUM_OUT_OF_SCOPE", concept.isNotNull()),
    )


def header_issues(chunk: Column) -> Column:
    """Presence and order of the three headers; an old answer header alone is no substitute."""
    p, q, e, old = place(chunk, PROBLEM), place(chunk, QUICK), place(chunk, EXPLANATION), place(chunk, LEGACY)
    return codes(
        ("no_problem", p == 0),
        ("legacy_answer_only", (q == 0) & (old > 0)),
        ("no_quick_answer", (q == 0) & (old == 0)),
        ("no_explanation", e == 0),
        ("wrong_order", (p > 0) & (q > 0) & (e > 0) & ~((p < q) & (q < e))),
        ("legacy_before_quick", (old > 0) & (q > 0) & (old < q)),
    )


def tag_issues(body: Column) -> Column:
    """Balance of <보기> tags, empty blocks and over-long lines within them."""
    opens, closes = F.regexp_count(body, F.lit("<보기>")), F.regexp_count(body, F.lit("</보기>"))
    inner = F.regexp_extract_all(body, F.lit(r"(?s)<보기>\s*(.*?)</보기>"), F.lit(1))
    filled = F.transform(inner, lambda b: F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    even = (opens > 0) & (opens == closes)
    return codes(
        ("close_without_open", (opens == 0) & (closes > 0)),
        ("unbalanced", (opens > 0) & (opens != closes)),
        ("empty_block", even & F.exists(filled, lambda b: F.size(b) == 0)),
        ("long_line", even & F.exists(F.flatten(filled), lambda x: F.length(x) > 200)),
        ("crossed", even & (F.size(inner) != opens)),
    )


def notation_issues(body: Column) -> Column:
    """Full stops after bare equations, interval membership, words that commands left behind, pictures."""
    picture = F.exists(lines(body), lambda x: x.rlike(FIGURE) & ~x.rlike(OWN_FIGURE))
    return codes(("equation_period", any_line(body, PERIOD)), ("membership_interval", any_line(body, MEMBERSHIP)), ("residue_word", any_line(body, RESIDUE)), ("figure", picture))


def bodies(chunk: Column) -> tuple[Column, Column]:
    """The problem body, up to the answer header, and the explanation body, to the end."""
    problem = F.regexp_extract(chunk, r"(?s)\[문제(?:\s+\d+)?\]\s*(.*?)\n?\s*(?:\d+\)\s*)?\[(?:빠른\s*정답|정답)\]", 1)
    return problem, F.regexp_extract(chunk, r"(?s)\[해설\]\s*(.*)", 1)


def export_issues(chunk: Column) -> Column:
    """Headers, tags and notation of a chunk together; what bears on a body is told by p: or e: before the code."""
    problem, explanation = bodies(chunk)
    marked = lambda side, issues: F.transform(issues, lambda c: F.concat(F.lit(side), c))
    in_problem = F.filter(notation_issues(problem), lambda c: c != "figure")
    return F.concat(header_issues(chunk), marked("p:", tag_issues(problem)), marked("p:", in_problem), marked("e:", notation_issues(explanation)))


#: Classes of a run's error message in lower case; the first that matches counts.
ERRORS = [
    ("quota-exhausted", r"quota|rate.?limit|429|resource_exhausted"),
    ("timeout", r"timeout|aborted|408|deadline"),
    ("format-mismatch", r"json|parse|format\s*미달|invalid.*format"),
    ("network", r"network|fetch|enotfound|econnrefused|502|503"),
    ("mathpix-error", r"mathpix"),
    ("gemini-error", r"gemini"),
    ("auth-error", r"auth|invalid_grant|401|403"),
    ("empty-output", r"empty|빈\s*텍스트|no\s*content"),
]

#: Labels of a step in lower case; several may hold.
FORMATS = [
    ("exam-name-or-output-format", r"형식\s*미달|format\s*mismatch|invalid\s*format"),
    ("json-parse-failed", r"json\s*파싱\s*실패|parse\s*failed"),
    ("header-unreadable", r"헤더\s*텍스트\s*못\s*읽음|cannot\s*read\s*header"),
]

STEPS = "struct<answer:string,explanation_steps:array<struct<text:string,equation:string,figure_hint:string>>,summary:string>"


def without_fences(text: Column) -> Column:
    """The text without a code fence before and after it."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^```(json)?\s*\n?", ""), r"\n?```\s*$", ""))


def output_issues(raw: Column) -> Column:
    """Faults of a generated answer: no object of JSON, fields missing, few steps, little text, commands left in it."""
    cleaned = without_fences(raw)
    parsed = F.from_json(cleaned, STEPS, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json(cleaned).isNotNull()
    steps = parsed["explanation_steps"]
    text = F.array_join(F.transform(F.coalesce(steps, F.array().cast("array<struct<text:string,equation:string,figure_hint:string>>")), lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    return F.when(~valid, F.array(F.lit("V1_json"))).otherwise(
        codes(
            ("V2_answer", F.coalesce(F.trim(parsed["answer"]), F.lit("")) == ""),
            ("V2_steps", steps.isNull()),
            ("V3_few_steps", F.size(steps) < 2),
            ("V4_short", F.length(text) < 50),
            ("V6_latex", text.rlike(r"\\(frac|sqrt|begin|end|left|right|cdot|times|sum|int)")),
        )
    )
