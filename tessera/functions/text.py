"""Text functions as column expressions.

Word edges are written out as "no letter or digit of ASCII beside", as \\b means different things to engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of documents: ASCII, no-break space, ideographic space, byte-order mark.
BLANK = r"[\s 　﻿]"
CIRCLED = "①②③④⑤"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def digest(text: Column, size: int = 80) -> Column:
    return F.substring(squeezed(text), 1, size)


def short_id(text: Column, size: int = 12) -> Column:
    return F.substring(F.sha1(text), 1, size)


def latin_and_hangul_tokens(text: Column) -> Column:
    """Latin words of two letters and more in lower case, then Hangul in chunks of two to four syllables."""
    latin = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0)), F.lower)
    return F.concat(latin, F.regexp_extract_all(text, F.lit("[가-힣]{2,4}"), F.lit(0)))


def equations(text: Column, most: int = 12) -> Column:
    """Distinct bodies of $$..$$ and $..$, trimmed, without blanks, the first of them."""
    block = F.regexp_extract_all(text, F.lit(r"\$\$([^$]+)\$\$"), F.lit(1))
    inline = F.regexp_extract_all(text, F.lit(r"\$([^$\n]+)\$"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(F.concat(block, inline), lambda x: F.trim(x)), lambda x: x != "")), 1, most)


def snippet(fields: list[Column], query: str, before: int = 40, after: int = 100) -> Column:
    """Context of the first occurrence of query in the first field that has it, with ellipses where cut."""
    q = F.lit(query.lower())

    def of(field: Column) -> Column:
        at = F.instr(F.lower(field), q)
        start = F.greatest(F.lit(1), at - before)
        end = F.least(F.length(field), at + len(query) - 1 + after)
        body = F.substring(field, start, end - start + 1)
        return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end < F.length(field), "…").otherwise("")))

    return F.coalesce(*[of(f) for f in fields])


def objective_answer(text: Column) -> Column:
    """1 to 5 from the forms ③, 3, (3), [3], $3$, 3번, or a circled and a plain figure that agree; else null."""
    plain = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", ""), CIRCLED, "12345")
    both = F.regexp_extract(plain, r"^([1-5])\(([1-5])\)$", 1), F.regexp_extract(plain, r"^([1-5])\(([1-5])\)$", 2)
    one = F.regexp_extract(plain, r"^[(\[$]?([1-5])[)\]$]?번?$", 1)
    return F.when((both[0] != "") & (both[0] == both[1]), both[0]).when(one != "", one).cast("int")


#: Patterns of a problem number, by priority; the number is in the first group.
NUMBER_PATTERNS = (
    r"\[(?:문항|해설)\s*(\d{1,3})\]",
    r"\*\*\s*(\d{1,3})\s*[.)]\s*\*\*",
    r"(?:예제|유형|문제|문항)\s*(\d{1,3})(?:[^A-Za-z0-9_]|$)",
    r"^\s*(\d{1,2})\s*[.)]\s+[가-힣$(\\\[°∀-⋿]",
    r"(?:^|[^A-Za-z0-9_])(\d{1,2})\s*번(?:[^A-Za-z0-9_]|$)",
)


def problem_number(text: Column, within: int = 250, highest: int = 99) -> Column:
    """The number by the first pattern whose first match is from 1 to highest, in the beginning of the squeezed text."""
    head = F.trim(F.substring(F.regexp_replace(text, BLANK + "+", " "), 1, within))
    found = [F.regexp_extract(head, p, 1).try_cast("int") for p in NUMBER_PATTERNS]
    return F.coalesce(*[F.when((n >= 1) & (n <= highest), n) for n in found])


def page_numbers(ranges: Column, last: int) -> Column:
    """Pages of '1,3-5 7~9': commas and blanks part them, - ~ and – span them, either way round; each page within 1..last once, in order."""
    plain = F.regexp_replace(ranges, "[~–]", "-")
    parts = F.filter(F.split(plain, r"[,\s]+"), lambda p: p.rlike(r"^\d+(-\d+)?$"))

    def pages(p: Column) -> Column:
        a = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
        b = F.regexp_extract(p, r"(\d+)$", 1).try_cast("int")
        low, high = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), F.lit(last))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def intersection_over_union(a: Column, b: Column) -> Column:
    """IoU of boxes with x0, y0, x1, y1."""
    side = lambda low, high: F.greatest(F.lit(0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    area = lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
    both = side("x0", "x1") * side("y0", "y1")
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def first_matching(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule (name, pattern) whose pattern is in the text."""
    out = F
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def all_matching(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The names of all rules whose pattern is in the text."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules]))
