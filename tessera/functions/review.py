"""Review rules for answers, solutions and scanned pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .issues import codes, lines
from .text import CIRCLED, first_matching

# Patterns, weights and limits of the exam format.
QUOTA, NO_KEY, NO_SECOND_KEY, RATE = r"(?i)RESOURCE_EXHAUSTED|spending\s*cap|quota", r"GEMINI_API_KEY 미설정", r"OPENAI_API_KEY 미설정", r"(?i)429|Too Many Requests|rate.*limit"
APPROXIMATE = r"≈|≅|어림|대충|가장\s*가까운|약\s*-?\d|참\s*정도로|근사적으로"
RAW_LATEX = r"\\(frac|sqrt|theta|alpha|beta|gamma|pi|infty|sum|int|times|div|cdot|leq|geq|neq|approx|left|right)([^A-Za-z0-9_]|$)"
ANY_CHOICE = r"[①②③④⑤⑥⑦⑧⑨⑩]"
UNREADABLE = r"확인\s*필요|주어지지\s*않|문제가\s*명확"
ANSWER, SOLUTION = r"(?i)\[정답\]\s*([^\n\r]*)", r"(?is)\[해설\]\s*(.+)"
CLOSED_CIRCLED = r"(따라서|그러므로|정답(은|이|으로))\s*([①②③④⑤])"
CLOSED_DIGIT = r"(따라서|그러므로|정답(은|이))\s*(보기\s*)?([1-5])(\s*번)?(\.|,|$|\s)"
CHOICES_NAMED, CHOICES_SHOWN, COMPUTED = r"보기|선택지|객관식", r"[①②③④⑤].{0,200}[①②③④⑤]", r"\\frac|\\sqrt|\\pi|\^\{"
DIAGRAM = [
    ("shape", 3, r"도형|기하|삼각형|사각형|원|부채꼴|현|접선|닮음|합동"),
    ("function", 3, r"삼각함수|사인|코사인|탄젠트|\\sin|\\cos|\\tan|주기|위상|이차함수|꼭짓점|포물선의\s*그래프|함수\s*y\s*="),
    ("crossing", 3, r"교점|만나는\s*점|서로\s*만나|x좌표|y좌표|좌표의\s*합|y\s*=\s*[0-9]|수평선|직선\s*y"),
    ("range", 2, r"\d\s*≤\s*x|x\s*≤\s*\d|x\s*<\s*\d|0\s*≤\s*x|몇\s*개의|서로\s*다른\s*실근"),
    ("plane", 2, r"좌표평면|그래프|함수의 그래프|포물선|직선의 기울기|절편"),
    ("drawing", 3, r"그림을 그려|도형을 그려|작도|보조선|연장선|수선의 발"),
    ("measure", 2, r"∠|각\s*[A-Z가-힣]|길이|넓이|둘레|반지름|지름"),
    ("picture", 2, r"그림|도표|도식|다음 도형|아래 그림"),
]
DIAGRAM_FROM = 4
SCOPE = [
    ("lhopital", r"(?i)로피탈|l['’]?\s*h[ôo]pital"),
    ("partial", r"(?i)편미분|partial derivative|∂"),
    ("linear_algebra", r"(?i)선형대수|linear algebra|고유값|고유벡터|eigenvalue|eigenvector"),
    ("jacobian", r"(?i)야코비안|jacobian"),
    ("lagrange", r"(?i)라그랑주\s*승수|lagrange multiplier"),
    ("vector_calculus", r"(?i)curl|divergence|gradient theorem|스토크스 정리|가우스 발산정리"),
    ("integral_signs", r"∮|⨌|삼중적분|다중적분"),
]
ESTIMATED = r"(?i)근삿?값|추정|근사|어림|대략|감으로|찍어서|적당히|approx(imately)?|≈|≒|약\s*\d"
EXACT, EXACT_END = r"(?i)[①②③④⑤]|\d+\s*/\s*\d+|[=<>≤≥]|\\frac|\\sqrt|π|pi", r"따라서\s*정답|그러므로\s*정답|결론적으로"
MOST_CHARS, MOST_LINES = {"killer": 5500, "easy": 1800, "balanced": 2800}, {"killer": 26, "easy": 12, "balanced": 16}
ITEM, SOLVED, SOLVED_WORD = r"\[문항\s*\d+\]", r"\[해설(\s*\d+)?\]|\[정답\s*및\s*해설\]", r"해설|풀이|정답"
OWNED_ANSWER = r"^(\d{1,3})(\s*\)\s*|\s*\.\s+)(\[정답\]|정답\])"
FORMULA_ERRORS = [("unsupported_token", "unsupported"), ("tree_invalid", "tree|invalid")]
LEAST_SIDE = 0.06


def run_issues(ok: Column, attempts: Column, errors: Column, answer: Column, summary: Column, steps: Column) -> Column:
    """Codes of a run (steps: an array of text and equation): what failed, else what to look at again."""
    full = F.concat_ws("\n", answer, summary, F.array_join(F.transform(steps, lambda s: F.concat_ws(" ", s["text"], s["equation"])), "\n"))
    cause = F.when(errors.rlike(QUOTA), "quota").when(errors.rlike(NO_KEY), "no_key").when(errors.rlike(NO_SECOND_KEY), "no_second_key").when(errors.rlike(RATE), "rate_limit")
    shown = F.exists(steps, lambda s: s["text"].rlike(ANY_CHOICE) | s["equation"].rlike(ANY_CHOICE))
    passed = codes(
        ("retried", attempts > 1),
        ("few_steps", F.size(steps) < 3),
        ("approximate", full.rlike(APPROXIMATE)),
        ("raw_latex", F.exists(steps, lambda s: s["text"].rlike(RAW_LATEX))),
        ("choice_notation", shown & ~answer.rlike(ANY_CHOICE)),
        ("no_answer", F.trim(answer) == ""),
    )
    return F.when(ok, passed).otherwise(F.array_compact(F.array(cause, F.lit("failed"))))


def reading_issues(answer: Column, steps: Column) -> Column:
    """Codes of an answer read from a picture; null steps stand for a response that was no JSON."""
    bare = F.size(F.filter(steps, lambda s: F.trim(s["equation"]) == "")) / F.greatest(F.size(steps), F.lit(1))
    found = codes(("few_steps", F.size(steps) < 2), ("unreadable", answer.rlike(UNREADABLE)), ("no_equations", bare > 0.7))
    return F.when(steps.isNull(), F.array(F.lit("no_json"))).otherwise(found)


def choice_issues(text: Column) -> Column:
    """Codes where the answered choice and the one that the solution closes with do not fit; both parts must be there."""
    own = F.when(text.rlike(r"\[정답\]"), F.substring(text, F.regexp_instr(text, F.lit(r"\[정답\]")), F.length(text))).otherwise(text)
    answer, solution = F.trim(F.regexp_extract(own, ANSWER, 1)), F.regexp_extract(own, SOLUTION, 1)
    number = F.translate(answer, CIRCLED, "12345")
    circled, figure = F.regexp_extract(solution, CLOSED_CIRCLED, 3), F.regexp_extract(solution, CLOSED_DIGIT, 4)
    closed = F.when(circled != "", F.translate(circled, CIRCLED, "12345")).otherwise(figure)
    is_choice = number.rlike("^[1-5]$")
    plain = F.regexp_replace(answer, r"\s", "")
    named = F.substring(solution, 1, 1200).rlike(CHOICES_NAMED) | F.substring(solution, 1, 900).rlike(CHOICES_SHOWN)
    large = plain.rlike("^[0-9]+$") & (plain.try_cast("bigint") > 5)
    computed = answer.rlike("[0-9]") & ~is_choice & (answer.contains("/") | F.coalesce(large, F.lit(False)) | answer.rlike(COMPUTED))
    both = (answer != "") & (F.trim(solution) != "")
    return codes(
        ("choice_differs", both & is_choice & (closed != "") & (closed != number)),
        ("computed_answer", both & named & computed),
        ("no_closing_choice", both & named & is_choice & (circled == "") & (figure == "")),
    )


def diagram_need(text: Column) -> Column:
    """(score, reasons): the summed weights of the rules that a question matches."""
    score = sum((F.when(text.rlike(p), w).otherwise(0) for _, w, p in DIAGRAM), F.lit(0))
    return F.struct(score.alias("score"), codes(*[(name, text.rlike(p)) for name, _, p in DIAGRAM]).alias("reasons"))


def scope_issues(text: Column) -> Column:
    return codes(*[(name, text.rlike(p)) for name, p in SCOPE])


def length_issues(text: Column, profile: Column) -> Column:
    """Estimates where an exact value is due, and solutions of one method that are too long for the profile."""
    answer, solution = F.trim(F.regexp_extract(text, ANSWER, 1)), F.trim(F.regexp_extract(text, SOLUTION, 1))
    estimated = F.concat_ws("\n", answer, solution).rlike(ESTIMATED)
    exact = answer.rlike(EXACT) | solution.rlike(EXACT_END)
    filled = F.filter(F.transform(lines(solution), lambda x: F.trim(x)), lambda x: x != "")
    numbered = F.size(F.filter(filled, lambda x: x.rlike(r"^\d+\.\s")))
    steps = (F.size(filled) >= 3) & (numbered >= 2) & (numbered / F.size(filled) >= 0.35)
    by = lambda most: F.when(profile == "killer", most["killer"]).when(profile == "easy", most["easy"]).otherwise(most["balanced"])
    long = F.when(steps, F.size(filled) > by(MOST_LINES)).otherwise(F.length(solution) > by(MOST_CHARS))
    one = F.regexp_count(solution, F.lit(r"\[방법\s*\d+\]")) <= 1
    return codes(("estimate_beside_exact", estimated & exact), ("estimate", estimated & ~exact), ("too_long", one & long))


def scan_issues(body: Column) -> Column:
    """Why a scanned page should be read again."""
    return codes(
        ("short", F.length(body) < 100),
        ("no_item", ~body.rlike(ITEM) & ~F.substring(body, 1, 200).rlike(r"\d+[.)]")),
        ("no_solution_mark", body.rlike(SOLVED_WORD) & ~body.rlike(SOLVED)),
    )


def formula_error(message: Column) -> Column:
    return first_matching(F.lower(F.coalesce(message, F.lit(""))), FORMULA_ERRORS, "parse_error")


def box(raw: Column) -> Column:
    """(nx, ny, nw, nh, confidence) from JSON within a text, clamped to 0 and 1; null where a side is below LEAST_SIDE."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    number = lambda k: F.get_json_object(body, f"$.{k}").try_cast("double")
    clamped = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    nx, ny, w, h = (clamped(number(k)) for k in ("nx", "ny", "nw", "nh"))
    nw, nh = F.when(nx + w > 1, 1 - nx).otherwise(w), F.when(ny + h > 1, 1 - ny).otherwise(h)
    whole = number("nx").isNotNull() & number("ny").isNotNull() & number("nw").isNotNull() & number("nh").isNotNull()
    fits = whole & (w >= LEAST_SIDE) & (h >= LEAST_SIDE) & (nw >= LEAST_SIDE) & (nh >= LEAST_SIDE)
    sure = clamped(F.coalesce(number("confidence"), F.lit(0.5)))
    return F.when(fits, F.struct(nx.alias("nx"), ny.alias("ny"), nw.alias("nw"), nh.alias("nh"), sure.alias("confidence")))


def first_difference(a: Column, b: Column) -> Column:
    """Where two texts first differ, from 0; -1 where they do not."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    return F.array_position(differ, True) - 1


def excerpt(text: Column, at: Column, radius: int = 36) -> Column:
    """radius characters on each side of a place, line feeds as \\n; empty for a place below 0."""
    start = F.greatest(at - radius, F.lit(0))
    cut = F.substring(text, (start + 1).cast("int"), (at + radius - start).cast("int"))
    return F.when(at < 0, "").otherwise(F.replace(cut, F.lit("\n"), F.lit("\\n")))


def patched_front_matter(md: Column) -> Column:
    """The text with .pdf taken from the type and the source of its front matter."""
    parts = F.split(md, "---", 3)
    of_type = lambda x: F.regexp_replace(x, r"(?i)^type:\s*(.*/)?([^/]+)\.pdf\s*$", "type: $2")
    of_source = lambda x: F.when(x.rlike(r"(?i)^sourceImage:"), F.regexp_replace(F.regexp_replace(x, r"(?i)^sourceImage:\s*", "sourceImage: "), r"([^/\\]+)\.pdf(?=#|/|$)", "$1")).otherwise(x)
    head = F.split(F.regexp_replace(F.get(parts, F.lit(1)), r"\n\z", ""), "\n")
    new = F.concat(F.lit("---\n"), F.array_join(F.transform(head, lambda x: of_source(of_type(x))), "\n"), F.lit("\n---\n"), F.get(parts, F.lit(2)))
    pdf = F.exists(head, lambda x: of_source(of_type(x)) != x)
    return F.when(md.startswith("---") & (F.size(parts) == 3) & pdf, new).otherwise(md)


def joined_front_matter_repaired(md: Column) -> Column:
    return F.regexp_replace(md, r"(#page=\d+)---", "$1\n---")


def styled(text: Column, most: int, suffix: str) -> Column:
    """A text without the marks U+0001 and U+0002, cut with a suffix after most characters."""
    plain = F.translate(text, "\u0001\u0002", "")
    cut = F.concat(F.regexp_replace(F.substring(plain, 1, most), r"[ \t\n\r]+\z", ""), F.lit(suffix))
    return F.when(F.length(plain) <= most, plain).otherwise(cut)


def foreign_answers(body: Column, owner: Column) -> Column:
    """Numbers of the answer headers of a body; those that are not the owner's; the latter only where the owner has one."""
    bare = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), r"^\$+\s*", "")), r"^\\\(\s*", "")))
    numbers = F.transform(F.filter(bare, lambda x: x.rlike(OWNED_ANSWER)), lambda x: F.regexp_extract(x, OWNED_ANSWER, 1).cast("int"))
    other = F.filter(numbers, lambda n: n != owner)
    strict = F.when(F.array_contains(numbers, owner), F.size(other)).otherwise(0)
    return F.struct(F.size(numbers).alias("headers"), F.size(other).alias("loose"), strict.alias("strict"))


def decoded(text: Column) -> Column:
    """The five entities of XML as characters."""
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def marked_equations(text: Column) -> tuple[Column, Column]:
    """The text with its U+0001 equations between $$ and blanks squeezed; and the equations."""
    shown = F.replace(F.regexp_replace(text, "\u0001([^\u0001]*)\u0001", r" \$\$$1\$\$ "), F.lit("\u0002IMG\u0002"), F.lit(" [그림] "))
    return F.trim(F.regexp_replace(shown, r"\s+", " ")), F.transform(F.regexp_extract_all(text, F.lit("\u0001([^\u0001]*)\u0001"), F.lit(1)), lambda x: F.trim(x))
