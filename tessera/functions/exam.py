"""Functions of exam documents as column expressions: splitters, normalisers, classes and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK, CIRCLED, objective_answer

ALL_CIRCLED = CIRCLED + "⑥⑦⑧⑨⑩"

# Markers, words and rates of the exam format.
SOLUTION_SECTION, PROBLEM_MARKER = r"\[정답\s*및\s*해설\]|\[해설\]\s*\n", r"\[문항\s*\d+\]"
COMPLEX = r"(이라\s*하자|조건을?\s*만족|풀이\s*과정|증명|구하는?\s*과정|서술하시오|\\sum|\\int|\\lim|\\frac|극한|급수|적분|미분|좌표평면\s*위의|일\s*때.*값을\s*구하시오)"
ESSAY = r"서술|논술|증명|과정을\s*쓰|풀이를\s*쓰|설명하|해설참고|서술형"
CENTS = {"gemini-2.0-flash-lite": 0.0125, "gemini-2.0-flash": 0.025, "gemini-2.5-flash": 0.025, "gemini-2.5-pro": 0.18, "gpt-4o-mini": 0.025, "gpt-4o": 0.4}
LINE_KINDS = [
    ("blank", r"^\s*$"),
    ("md_image", r"^\s*!\[[^\]]*\]\([^)]+\)\s*$"),
    ("문항", r"^\s*\[문항\s*\d+\]\s*$"),
    ("문제_번호접두", r"^\s*\d+\)\s*\[문제\]\s*$"),
    ("문제_일반", r"^\s*\[문제(\s+\d+)?\]\s*$"),
    ("빠른정답_번호접두", r"^\s*\d+\)\s*\[빠른\s*정답\]\s*$"),
    ("빠른정답_일반", r"^\s*\[빠른\s*정답\]\s*$"),
    ("해설", r"^\s*\[해설\]\s*$"),
]
SECTION_HEADER = r"(^|\n)\s*[■▣◎●▶➤]?\s*(?:정답\s*[·및과]?\s*해설|풀이\s*및\s*정답|해설\s*및\s*정답|정답\s*해설)\s*\n"
LONE_HEADER = r"(^|\n)\s*(?:풀이|해설)\s*\n(?=[\s\S]{50,})"
PROBLEM_HEADERS = [
    (r"(^|\n)\s*\*\*\s*(\d{1,3})\s*[.)]\s*\*\*", "$1[문항 $2]"),
    (r"(^|\n)\s*(?:예제|유형|문제)\s*(\d{1,3})\s*[.:)]?\s*(?=\n|\S)", "$1[문항 $2]\n"),
    (r"(^|\n)\s*(\d{1,2})\s*[.)]\s+(?=[가-힣$(\\\[°∀-⋿])", "$1[문항 $2]\n"),
]
ANSWER_LINE = r"(^|\n)\s*[■▣◎●▶➤]?\s*\*?\*?\[?\s*정\s*답\s*\]?\*?\*?\s*[:.]?\s*([①-⑩0-9A-Za-z_$\\][^\n]*)"
REST = r"([\s\S]*)\z"
CONNECTIVES = "따라서|이제|그러므로|즉|한편|또한|먼저|그래서|이때"


def normalised(text: Column) -> Column:
    """struct(text, rules): markers of scanned texts in their standard forms, and the names of the rules that changed it.

    Rules for section and problem markers rest where standard markers are there already.
    """
    # a match takes the rest of the text with it, so the first header alone is replaced
    section = F.regexp_replace(text, SECTION_HEADER + REST, "$1[정답 및 해설]\n$2")
    alone = F.regexp_replace(text, LONE_HEADER + REST, "$1[정답 및 해설]\n$2")
    one = F.when(text.rlike(SOLUTION_SECTION), text).when(section != text, section).otherwise(alone)
    problem = one
    for pattern, marker in PROBLEM_HEADERS:
        problem = F.regexp_replace(problem, pattern, marker)
    two = F.when(text.rlike(PROBLEM_MARKER), one).otherwise(problem)
    three = F.regexp_replace(two, ANSWER_LINE, "$1[정답] $2")
    four = F.regexp_replace(F.regexp_replace(three, r"\[해설\]\s*(\d{1,3})", "[해설 $1]"), r"\[해설\s*(\d{1,3})\s*\]", "[해설 $1]")
    rules = [("solution-section-standardized", text, one), ("problem-marker-standardized", one, two), ("answer-line-standardized", two, three), ("solution-marker-standardized", three, four)]
    return F.struct(four.alias("text"), F.array_compact(F.array(*[F.when(a != b, F.lit(n)) for n, a, b in rules])).alias("rules"))


def packed_paragraphs(text: Column, most: int = 1500) -> Column:
    """Paragraphs joined to chunks of at most most letters; a longer paragraph is a chunk of its own."""
    paragraphs = F.filter(F.split(F.trim(text), r"\n\s*\n+"), lambda p: F.trim(p) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def add(acc: Column, p: Column) -> Column:
        joined = F.when(acc["buf"] == "", p).otherwise(F.concat(acc["buf"], F.lit("\n\n"), p))
        full = (acc["buf"] != "") & (F.length(acc["buf"]) + 2 + F.length(p) > most)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(F.trim(acc["buf"])))).otherwise(acc["done"]).alias("done"), F.when(full, p).otherwise(joined).alias("buf"))

    return F.aggregate(paragraphs, start, add, lambda acc: F.when(F.trim(acc["buf"]) == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(F.trim(acc["buf"])))))


def labelled_chunks(text: Column) -> Column:
    """array of struct(label, chunk) by [문항 n]; what stands before the first label is left out, and so are empty chunks."""
    pieces = F.slice(F.split(text, r"(?=\[문항\s*\d+\])"), 1, 100_000)
    labelled = F.filter(pieces, lambda p: p.rlike(r"^\[문항\s*\d+\]"))
    split = F.transform(labelled, lambda p: F.struct(F.regexp_extract(p, r"^\[문항\s*(\d+)\]", 1).alias("label"), F.trim(F.regexp_replace(p, r"^\[문항\s*\d+\]\s*|\s+$", "")).alias("chunk")))
    return F.filter(split, lambda c: c["chunk"] != "")


def choices(text: Column) -> Column:
    """struct(stem, choices) at circled figures, without blanks and line ends around; with fewer than two of them all is stem."""
    bare = lambda x: F.btrim(x, F.lit("\n "))
    parts = F.transform(F.split(text, f"[{ALL_CIRCLED}]"), bare)
    few = F.size(parts) < 3
    return F.struct(F.when(few, bare(text)).otherwise(parts[0]).alias("stem"), F.when(few, F.array().cast("array<string>")).otherwise(F.slice(parts, F.lit(2), F.size(parts))).alias("choices"))


def series_and_kind(source: Column) -> Column:
    """struct(series, kind) of a file's name; solution wins over problem, and null stands for neither."""
    name = F.element_at(F.split(source, "/"), -1)
    kind = F.when(F.lower(name).rlike("해설|정답|answer|solution"), "solution").when(F.lower(name).rlike("문제|기출|워크북|problem|question"), "problem")
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    series = F.trim(F.regexp_replace(F.regexp_replace(stem, r"(?i)[_\s-]?(문제|기출|워크북|problem|question|해설|정답|answer|solution)[_\s-]?", " "), r"\s+", " "))
    return F.when(kind.isNotNull() & (series != ""), F.struct(series.alias("series"), kind.alias("kind")))


def series_key(pair_series: Column, source: Column) -> Column:
    """The trimmed series, else the last part of the path."""
    return F.coalesce(F.nullif(F.trim(pair_series), F.lit("")), F.element_at(F.split(source, "/"), -1))


def difficulty(number: Column, text: Column) -> Column:
    """easy, balanced or killer by number, length, choices and key words, the first rule that holds."""
    n = F.nullif(F.regexp_replace(number, "[^0-9]", ""), F.lit("")).try_cast("int")
    length, chosen, hard = F.length(text), text.rlike(f"[{ALL_CIRCLED}]"), text.rlike(COMPLEX)
    return (
        F.when(F.coalesce(n >= 17, F.lit(False)) | (length >= 600) | ((length >= 350) & hard), "killer")
        .when(F.coalesce(n.between(1, 7), F.lit(False)) & chosen & (length < 220), "easy")
        .when(chosen & (length < 150), "easy")
        .when(hard, "killer")
        .otherwise("balanced")
    )


def cost_cents(model: Column, chars: Column, other: float = 0.05) -> Column:
    rate = F.coalesce(*[F.when(model == k, v) for k, v in CENTS.items()], F.lit(other))
    return chars * 1.7 / 1000 * rate


def valid_exam_name(name: Column) -> Column:
    return F.coalesce((F.length(name) >= 10) & name.rlike(r"^[중고]\s*\d\s*\)") & name.rlike(r"\d\s*학년\s*\d\s*학기") & name.rlike(r"(중간고사|기말고사)\s*$"), F.lit(False))


def safe_name(name: Column, most: int = 80) -> Column:
    """A file's name without signs that file systems forbid, blanks squeezed and length cut; '-' if nothing is left."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"), r"\s+", " "))
    return F.coalesce(F.nullif(F.substring(plain, 1, most), F.lit("")), F.lit("-"))


def source_normalised(text: Column) -> Column:
    """Won signs, full-width signs and damaged commands of equations in their plain forms; \\cdot becomes \\times."""
    plain = F.translate(text, "₩￦＼＄", "\\\\\\$")
    for name in ("sqrt", "frac", "log"):
        plain = F.regexp_replace(plain, rf"(?i)#w?{name}(?![A-Za-z0-9_])", rf"\\{name}")
    return F.regexp_replace(plain, r"\\cdot(?!s)", r"\\times")


def loosened(text: Column) -> Column:
    """Line feeds after sentences and before connectives; three and more become two."""
    s = F.trim(F.regexp_replace(text, "\r\n", "\n"))
    s = F.regexp_replace(s, r"([가-힣]{2,})\.\s+(?=[가-힣])", "$1.\n")
    s = F.regexp_replace(s, rf"(\d)\.\s+({CONNECTIVES}|주어진|구하면|따라)(?=[가-힣])", "$1.\n$2")
    s = F.regexp_replace(s, r"([^\n])\s+(따라서|그러므로|한편|또한|즉,|즉\s)(?=[\s가-힣])", "$1\n$2")
    return F.trim(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def compacted(line: Column) -> Column:
    """A display equation of 150 letters and six equalities or more: its first two and its last two parts."""
    inner = F.trim(F.regexp_extract(F.trim(line), r"^\$\$([\s\S]+)\$\$$", 1))
    parts = F.filter(F.transform(F.split(inner, "="), lambda x: F.trim(x)), lambda x: x != "")
    long = (F.length(inner) >= 150) & (F.regexp_count(inner, F.lit("=")) >= 6) & (F.size(parts) >= 7)
    short = F.concat(F.lit("$$"), F.array_join(F.slice(parts, 1, 2), " = "), F.lit(" = \\cdots = "), F.array_join(F.slice(parts, -2, 2), " = "), F.lit("$$"))
    return F.when(long, short).otherwise(line)


def answer_kind(answer: Column, explanation: Column) -> Column:
    """objective, essay or short."""
    clean = F.trim(answer)
    noted = clean.rlike(r"^[①②③④⑤]|^[1-5]\s*번|^\(\s*[1-5]\s*\)")
    prose = (F.length(clean) >= 36) & ~noted & F.regexp_replace(clean, r"\([^)]*\)", "").rlike(r"[.!?。…]\s*\S")
    return F.when(objective_answer(answer).isNotNull(), "objective").when(F.concat_ws(" ", clean, explanation).rlike(ESSAY) | prose, "essay").otherwise("short")


def line_kind(line: Column) -> Column:
    return F.coalesce(*[F.when(line.rlike(p), n) for n, p in LINE_KINDS], F.lit("other"))


def last_right_side(equation: Column) -> Column:
    """What stands after the last equality sign."""
    return F.trim(F.substring_index(equation, "=", -1))


def last_equation(equations: Column, text: Column, tail: int = 40) -> Column:
    """The last equation that is not blank, else the end of the text."""
    return F.coalesce(F.try_element_at(F.filter(equations, lambda e: F.trim(e) != ""), F.lit(-1)), F.substring(text, -tail, tail))


def one_blank_line(lines: Column) -> Column:
    """Lines without blank ones that follow a blank one."""
    return F.filter(lines, lambda x, i: (F.trim(x) != "") | (i == 0) | (F.trim(F.get(lines, i - 1)) != ""))


def squeezed_snippet(text: Column, most: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, BLANK + "+", " ")), 1, most)
