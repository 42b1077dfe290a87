"""Commands of formulas outside formulas and code: one pass that masks, then patterns over what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commands, environments and marks that may not stand outside formulas
COMMANDS = (
    "frac|dfrac|tfrac|sqrt|binom|sin|cos|tan|cot|sec|csc|sinh|cosh|tanh|log|ln|lg|exp|lim|sum|int|oint|prod|cdot|times|div|pm|mp|leq|geq|le|ge|ne|neq|approx|equiv|iff|implies|to|"
    "rightarrow|Rightarrow|Leftarrow|Leftrightarrow|leftrightarrow|mapsto|arcsin|arccos|arctan|left|right|bigl|bigr|Bigl|Bigr|biggl|biggr|middle|overline|underline|overbrace|underbrace|"
    "displaystyle|text|mathrm|textrm|mathbf|mathbb|mathcal|mathit|vec|hat|bar|dot|ddot|tilde|widehat|widetilde|theta|pi|alpha|beta|gamma|delta|phi|varphi|sigma|Sigma|omega|varepsilon|"
    "Delta|Gamma|cdots|ldots|dots|vdots|ddots|infty|partial|subset|supset|subseteq|supseteq|cup|cap|setminus|emptyset|varnothing|sim|simeq|propto|angle|perp|parallel|circ|deg|triangle|nabla|hline|vline"
)
PATTERNS = [
    r"(?i)\\(?:begin|end)\s*\{\s*[^}\s]+\s*\}",
    r"\\[\[\]()]",
    rf"(?i)\\(?:{COMMANDS})(?![a-zA-Z])",
    r"\\(?:quad|qquad|,|;|:|!)(?![a-zA-Z])",
    r"\\[_^]",
]
LINE, MATCH = 120, 80

MARK = "\x00"
# a dollar sign after an odd number of backslashes is text; then what is closed, and last what is not
LITERAL = r"(?<!\\)(?:\\\\)*\\\$"
FENCE, DISPLAY, INLINE = r"```.*?```", r"\$\$.*?\$\$", r"\$.*?\$"
TOKEN = rf"(?s)({LITERAL})|{FENCE}|```.*|{DISPLAY}|\$\$.*|{INLINE}|\$.*"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row; a lambda computes an expression of columns anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _ends(text: Column) -> Column:
    """The line ends of a text without what is between them."""
    return F.regexp_replace(text, "[^\n]+", "")


def _numbered(line: Column, match: Column) -> Column:
    """A hit as a string, by which equal ones are told."""
    return F.concat(line.cast("string"), F.lit(":"), match)


def _found(text: Column, pattern: str) -> Column:
    """Matches of pattern, each after the number of the line that it begins in.

    Of the text only line ends and a mark for each match are kept, so a line has as many marks as matches begin in it.
    """
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def numbered(hits: Column) -> Column:
        pairs = F.arrays_zip(parts.alias("p"), hits.alias("h"))
        marks = F.transform(pairs, lambda x: F.concat(_ends(x["p"]), F.when(x["h"].isNotNull(), F.concat(F.lit(MARK), _ends(x["h"]))).otherwise("")))
        lines = F.flatten(F.transform(F.split(F.array_join(marks, ""), "\n", -1), lambda m, i: F.array_repeat(i + 1, F.length(m))))
        return F.transform(F.arrays_zip(lines.alias("l"), hits.alias("h")), lambda x: _numbered(x["l"], F.substring(x["h"], 1, MATCH)))

    return F.when(text.rlike(pattern), bound(hits, numbered)).otherwise(F.array().cast("array<string>"))


def stray_commands(text: Column) -> Column:
    """(line, match, text) of what is left of formulas outside $...$, $$...$$ and ```...```, and of unclosed ones.

    A dollar sign after an odd number of backslashes opens nothing.  Unclosed delimiters come first, as unclosed_fence,
    unclosed_display or unclosed_inline, and mask all that follows.  Of equal lines and matches one is kept.  Null gives null.
    """
    clean = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), MARK, "\ufffd")
    return F.when(text.isNotNull(), bound(clean, lambda clean: bound(_tokens(clean), lambda tokens: _hits(clean, tokens))))


def _tokens(clean: Column) -> Column:
    return F.filter(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(r"\A\\"))


def _masked(clean: Column, tokens: Column) -> Column:
    """The text with marks in place of what is masked, with its line ends, so that lines keep their numbers."""
    outside = F.split(F.replace(F.regexp_replace(clean, TOKEN, "$1" + MARK), F.lit("\\$" + MARK), F.lit("\\$")), MARK, -1)
    pairs = F.transform(F.arrays_zip(outside.alias("o"), tokens.alias("t")), lambda x: F.concat(x["o"], F.when(x["t"].isNotNull(), F.concat(F.lit(MARK), _ends(x["t"]))).otherwise("")))
    return F.array_join(pairs, "")


def _unclosed(clean: Column, last: Column) -> Column:
    kind = F.when(last.startswith("```"), "unclosed_fence").when(last.startswith("$$"), "unclosed_display").otherwise("unclosed_inline")
    closed = F.when(last.startswith("```"), last.rlike(rf"(?s)\A{FENCE}\z")).when(last.startswith("$$"), last.rlike(rf"(?s)\A{DISPLAY}\z")).otherwise(last.rlike(rf"(?s)\A{INLINE}\z"))
    at = _lines(clean) - _lines(last) + 1
    return F.when(last.isNotNull() & ~closed, F.array(_numbered(at, kind))).otherwise(F.array().cast("array<string>"))


def _hits(clean: Column, tokens: Column) -> Column:
    first = bound(F.try_element_at(tokens, F.lit(-1)), lambda last: _unclosed(clean, last))
    found = bound(_masked(clean, tokens), lambda masked: F.concat(*[_found(masked, p) for p in PATTERNS]))

    def listed(lines: Column) -> Column:
        line = lambda h: F.substring_index(h, ":", 1).cast("int")
        own = lambda h: F.coalesce(F.get(lines, line(h) - 1), F.lit(""))
        # lines of pictures are left out; those of one number have one text, so equal strings are equal hits
        kept = F.array_distinct(F.concat(first, F.filter(found, lambda h: ~own(h).startswith("!["))))
        return F.transform(kept, lambda h: F.struct(line(h).alias("line"), F.regexp_replace(h, r"\A\d+:", "").alias("match"), F.substring(own(h), 1, LINE).alias("text")))

    # a line is trimmed once, not for each of its hits
    return bound(F.transform(F.split(clean, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), listed)
