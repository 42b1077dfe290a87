"""Structure of written solutions: their headers and order, what was cut off, what came from other items, small predicates."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .exam import PROBLEM_MARKER, line_kind
from .text import CIRCLED

# Headers, texts of the interface, limits and patterns of the rules
ANSWER, EXPLANATION, QUICK = r"(?i)\[정답\]", r"(?i)\[해설\]", r"(?i)\[빠른\s*정답\]"
ANY_ANSWER = r"(?i)\[(?:빠른\s*정답|정답)\]"
LEFT_OVER = r"해설 생성 버튼을 누르면|이 영역에 결과가 표시됩니다"
OPEN_END = r"[,:+\-*/=]\z"
BLEED = [
    ("goes_on", r"(?m)(?:^|\n)\s*(?:다음|이어서|또\s*다른)\s*문제"),
    ("other_number", r"(?m)(?:^|\n)\s*(?:[3-9]|1[0-9])\s*번\s*(?:문항|문제)"),
    ("numbered_answer", r"(?i)\d+\)\s*\[정답\]"),
    ("listed_answer", r"(?im)(?:^|\n)\s*\d+\.\s*\[정답\]"),
    ("inner_answer", r"(?i)\[정답\]"),
]
RAW_COMMANDS = [r"\\frac(?![A-Za-z0-9_])", r"\\sqrt(?![A-Za-z0-9_])", r"\\sum(?![A-Za-z0-9_])", r"\\int(?![A-Za-z0-9_])", r"\\(?:alpha|beta|gamma|delta|pi|theta|sigma|lambda|omega)(?![A-Za-z0-9_])", r"[\^_]\{[^}]+\}"]
SHORT_BODY, SHORT_FORMAT, SHORT_RESULT, LONG_INTRO, LONG_EQUATION = 20, 35, 50, 40, 150
FALLBACK_ERROR, FALLBACK_WARN = 0.5, 0.3
GRAPH_FIGURE = r"(?i)!\[[^\]]*\]\([^)]*(?:그래프[^)]*\.(?:png|jpe?g|webp)|문항\d+_그래프\.png)\)"
CONFIDENT = 0.75
MODELS, PROFILES = ["gemini", "openai"], ["easy", "balanced", "killer", "auto"]
DEFAULTS = {"model": "gemini", "profile": "auto", "top_k": 3, "retries": 2}


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def _issues(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules]))


def explanation(text: Column) -> Column:
    """What follows the first header of an explanation."""
    return _stripped(F.regexp_extract(text, rf"(?s){EXPLANATION}\s*(.*)", 1))


def format_issues(text: Column) -> Column:
    """A solution begins with its answer and has one explanation of some length; what stands before the answer is left out."""
    whole = _stripped(text)
    own = F.when(whole.rlike(ANSWER), _stripped(F.concat(F.regexp_extract(whole, rf"({ANSWER})", 1), F.get(F.split(whole, ANSWER, 2), F.lit(1))))).otherwise(whole)
    count = F.regexp_count(own, F.lit(EXPLANATION))
    body, answer = explanation(own), F.trim(F.regexp_extract(own, rf"{ANSWER}\s*([^\n\r]*)", 1))
    return _issues(
        ("no_leading_answer", ~own.rlike(rf"^\s*{ANSWER}")),
        ("no_explanation", count == 0),
        ("many_explanations", count > 1),
        ("no_answer", own.rlike(ANSWER) & (answer == "")),
        ("short_explanation", (count > 0) & (F.length(body) < SHORT_FORMAT)),
    )


def truncated(text: Column) -> Column:
    """Whether an explanation is too short, ends in the middle of an expression, or leaves brackets open."""
    body = explanation(text)
    opened, closed = F.regexp_count(body, F.lit(r"[({\[]")), F.regexp_count(body, F.lit(r"[)}\]]"))
    return (F.length(body) < SHORT_RESULT) | body.rlike(OPEN_END) | (opened > closed)


def _choice(text: Column) -> Column:
    return F.translate(F.trim(text), CIRCLED, "12345")


def answer_conflicts(text: Column) -> Column:
    """(conflicts, mixed): items whose explanation declares another choice than their answer; choices and values mixed."""
    pieces = F.slice(F.split(F.concat(F.lit(" "), text), rf"(?={ANSWER})"), 2, 1_000_000)
    answers = F.transform(pieces, lambda p: _choice(F.regexp_extract(p, rf"{ANSWER}[^\S\n\r]*([^\n\r]*)", 1)))
    declared = lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"정답(?:은|:)?\s*([①②③④⑤1-5])"), F.lit(1)), _choice)
    clash = F.transform(pieces, lambda p, i: F.get(answers, i).rlike(r"\A[1-5]\z") & F.exists(declared(p), lambda d: d != F.get(answers, i)))
    objective, other = F.exists(answers, lambda a: a.rlike(r"\A[1-5]\z")), F.exists(answers, lambda a: (a != "") & ~a.rlike(r"\A[1-5]\z"))
    return F.struct(F.size(F.filter(clash, lambda c: c)).alias("conflicts"), ((F.size(answers) > 1) & objective & other).alias("mixed"))


def bleed_issues(text: Column) -> Column:
    """Signs of other items in a solution that is to hold one."""
    body = explanation(text)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(_issues(*[(name, body.rlike(p)) for name, p in BLEED], ("many_answers", F.regexp_count(text, F.lit(ANSWER)) > 1)))


def consistency(text: Column, equations: Column, attempts: Column, fallbacks: Column) -> Column:
    """(severity, issues): share of formulas that could not be converted, commands outside formulas, overlong equations."""
    rate = F.when(attempts > 0, fallbacks / attempts)
    outside = F.regexp_replace(F.regexp_replace(text, r"(?s)\$\$.+?\$\$", ""), r"\$[^$\n]+\$", "")
    raw = outside.rlike("|".join(RAW_COMMANDS))
    long = F.exists(equations, lambda e: F.length(e) > LONG_EQUATION)
    issues = _issues(("fallback_half", rate >= FALLBACK_ERROR), ("fallback_third", (rate >= FALLBACK_WARN) & (rate < FALLBACK_ERROR)), ("raw_command", raw), ("long_equation", long))
    severity = F.when(F.coalesce(rate >= FALLBACK_ERROR, F.lit(False)), "error").when(F.size(issues) > 0, "warn").otherwise("ok")
    return F.struct(severity.alias("severity"), issues.alias("issues"))


def header_issues(chunk: Column) -> Column:
    """An item's strict order: `n) [문제]` first, then `n) [빠른 정답]`, then `[해설]`, each on a line of its own."""
    kinds = F.transform(F.split(F.regexp_replace(chunk, "\r\n", "\n"), "\n", -1), line_kind)
    # blank lines and then pictures may come before the first header
    blanks = F.coalesce(F.array_position(F.transform(kinds, lambda k: k != "blank"), True), F.lit(0)).cast("int")
    rest = F.when(blanks > 0, F.slice(kinds, blanks, F.size(kinds))).otherwise(F.array(F.lit("blank")))
    pictures = F.array_position(F.transform(rest, lambda k: k != "md_image"), True).cast("int")
    first = F.when(pictures > 0, F.get(rest, pictures - 1)).otherwise("blank")
    place = F.when((blanks > 0) & (pictures > 0), blanks + pictures - 1).otherwise(F.size(kinds) + 1)
    quick, body = F.array_position(kinds, "빠른정답_번호접두"), F.array_position(kinds, "해설")
    strict = first == "문제_번호접두"
    return _issues(("no_numbered_problem", ~strict), ("no_numbered_answer", quick == 0), ("no_explanation", body == 0), ("wrong_order", strict & (quick > 0) & (body > 0) & ~((place < quick) & (quick < body))))


def merged_issues(text: Column) -> Column:
    """A merged text as a whole: empty, an odd number of dollar signs, a long beginning before the first item, repeated items."""
    whole = _stripped(F.regexp_replace(text, "\r\n", "\n"))
    labels = F.regexp_extract_all(whole, F.lit(r"\[문항\s*(\d+)\]"), F.lit(1))
    intro = _stripped(F.get(F.split(whole, PROBLEM_MARKER, 2), F.lit(0)))
    return _issues(
        ("empty", whole == ""),
        ("odd_dollars", F.regexp_count(whole, F.lit(r"\$")) % 2 == 1),
        ("long_intro", (F.size(labels) > 0) & (F.length(intro) > LONG_INTRO)),
        ("repeated_item", F.size(labels) > F.size(F.array_distinct(labels))),
    )


def chunk_issues(chunk: Column) -> Column:
    """An item of a merged text: its headers and their order, its answer, its explanation."""
    heads = F.regexp_extract(chunk, rf"(?s)^(.*?){ANY_ANSWER}", 1)
    has_answer, has_body = chunk.rlike(ANY_ANSWER), chunk.rlike(EXPLANATION)
    before = F.length(heads) > F.length(F.get(F.split(chunk, EXPLANATION, 2), F.lit(0)))
    answer = _stripped(F.coalesce(F.nullif(F.regexp_extract(chunk, rf"{ANY_ANSWER}\s*\n\s*([^\n\r]+)", 1), F.lit("")), F.regexp_extract(chunk, rf"{ANY_ANSWER}\s*([^\n\r]+)", 1)))
    body = explanation(chunk)
    return _issues(
        ("no_answer_header", ~has_answer),
        ("no_explanation", ~has_body),
        ("wrong_order", has_answer & has_body & before),
        ("plain_answer_header", ~chunk.rlike(QUICK) & chunk.rlike(ANSWER)),
        ("empty_answer", has_answer & (answer == "")),
        ("formula_in_answer", answer.rlike(r"(?i)\\[a-z]+") | answer.rlike(r"\$[^$]+\$")),
        ("short_explanation", has_body & (F.length(body) < SHORT_BODY)),
        ("interface_text", body.rlike(LEFT_OVER)),
    )


def method_blocks(text: Column) -> Column:
    """(intro, methods): what stands before the first `[방법 n]`, and each method up to the next one's line."""
    methods = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(\[방법\s*\d+\].*?)(?=\n\s*\[방법\s*\d+\]|\z)"), F.lit(1)), _stripped)
    intro = F.when(F.size(methods) == 0, _stripped(text)).otherwise(_stripped(F.get(F.split(text, r"\[방법\s*\d+\]", 2), F.lit(0))))
    return F.struct(intro.alias("intro"), methods.alias("methods"))


def normal_delimiters(text: Column) -> Column:
    """\\[...\\] as $$...$$ and \\(...\\) as $...$, and no full stop at the end of a formula."""
    out = F.regexp_replace(text, r"(?s)\\\[\s*(.*?)(?:\.\s*)?\\\]", r"\$\$$1\$\$")
    out = F.regexp_replace(out, r"(?s)\s+\$\$(?=\z|\n)", r"\$\$")
    return F.regexp_replace(out, r"\\\([^\S\n]*(\S.*?)[^\S\n]*\\\)", r"\$$1\$")


def python_blocks(text: Column) -> Column:
    """(blocks, rest): the python code of a text, and the text without it, three and more line feeds as two."""
    code = r"(?is)```python\s*(.*?)```"
    blocks = F.filter(F.transform(F.regexp_extract_all(text, F.lit(code), F.lit(1)), _stripped), lambda b: b != "")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, code, ""), r"\n{3,}", "\n\n"), r"\s+\z", "")
    return F.struct(blocks.alias("blocks"), rest.alias("rest"))


def response_truncated(json: Column) -> Column:
    """Whether a model's answer says that it met the limit of tokens; not JSON, no."""
    return F.coalesce(F.get_json_object(json, "$.candidates[0].finishReason") == "MAX_TOKENS", F.lit(False))


def confident_text(text: Column, confidence: Column, least: float = CONFIDENT) -> Column:
    """The trimmed text, null if it is empty or its confidence is known and too low."""
    return F.when(F.isnan(confidence) | confidence.isNull() | (confidence >= least), F.nullif(F.trim(text), F.lit("")))


def normal_options(model: Column, profile: Column, top_k: Column, retries: Column) -> Column:
    """Options with defaults in place of unknown names and numbers out of range, numbers rounded down."""
    pick = lambda c, known, name: F.when(c.isin(known), c).otherwise(DEFAULTS[name])
    within = lambda c, low, name, high: F.when(low & (c <= high), F.floor(c)).otherwise(DEFAULTS[name]).cast("long")
    return F.struct(pick(model, MODELS, "model").alias("model"), pick(profile, PROFILES, "profile").alias("profile"), within(top_k, top_k > 0, "top_k", 20).alias("top_k"), within(retries, retries >= 0, "retries", 10).alias("retries"))


def solution_file(text: Column, least: int = 40) -> Column:
    """Whether a file is a solution: it begins with a header and has an explanation of some length."""
    return F.regexp_replace(text, r"^[﻿\s]+", "").rlike(r"(?i)\A\[(?:문제|정답)\]") & (F.length(explanation(text)) >= least)


def data_url(text: Column) -> Column:
    """The bytes of an image given as a data URL; null for anything else."""
    coded = F.regexp_replace(F.regexp_extract(text, r"(?is)\Adata:image/[a-z0-9.+-]+;base64,(.+)\z", 1), r"\s", "")
    return F.when(coded != "", F.try_to_binary(coded, F.lit("base64")))


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType())]))
def _frame(data: pd.Series) -> pd.DataFrame:
    """Width and height of JPEGs from their first frame header, segment by segment; nulls for anything else."""
    sizes = [_frame_size(d) if d is not None and d[:3] == b"\xff\xd8\xff" else None for d in data]
    return pd.DataFrame({k: pd.array([None if s is None else s[i] for s in sizes], "Int64") for i, k in enumerate(("width", "height"))})


def _frame_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at < len(data) - 9:
        if data[at] != 0xFF:
            at += 1
        elif data[at + 1] in (0xC0, 0xC1, 0xC2):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def raster(data: Column) -> Column:
    """(kind, width, height) of a picture by its bytes; null for other bytes, sizes null where the header is cut off."""
    h, size, jpeg = F.hex(F.substring(data, 1, 26)), F.length(data), _frame(data)
    number = lambda at, n: F.conv(F.substring(h, 2 * at + 1, 2 * n), 16, 10).cast("long")
    little = lambda at, n: F.conv(F.concat(*[F.substring(h, 2 * (at + k) + 1, 2) for k in reversed(range(n))]), 16, 10).cast("long")
    kind = F.when((size >= 8) & h.startswith("89504E47"), "png").when((size >= 3) & h.startswith("FFD8FF"), "jpg").when((size >= 6) & h.rlike("^474946(38|39)"), "gif").when((size >= 6) & h.startswith("424D"), "bmp")
    tall = F.abs(F.when(little(22, 4) >= 1 << 31, little(22, 4) - (1 << 32)).otherwise(little(22, 4)))  # a negative height: rows from the top
    enough = F.when(kind == "png", size >= 24).when(kind == "gif", size >= 10).when(kind == "bmp", size >= 26)
    width = F.when(kind == "jpg", jpeg["width"]).when(enough, F.when(kind == "png", number(16, 4)).when(kind == "gif", little(6, 2)).otherwise(little(18, 4)))
    height = F.when(kind == "jpg", jpeg["height"]).when(enough, F.when(kind == "png", number(20, 4)).when(kind == "gif", little(8, 2)).otherwise(tall))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), width.alias("width"), height.alias("height")))
