"""Texts that lost numbers and formulas on their way out of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scan import bound

# Patterns of lost values, from how many hits each counts, and hits per 1,000 characters of a damaged text
SPACES = " \t\n\x0b\f\r\xa0\u3000"
SPACE = f"[{SPACES}]"
EMPTY_CHOICES = rf"[①②③④⑤⑥⑦⑧⑨⑩]{SPACE}{{2,}}(?=[①②③④⑤⑥⑦⑧⑨⑩]|\n|\z)"
EMPTY_UNITS = rf"{SPACE}{{2,}}(?:명|원|개|점|장|번|회|배|쪽)"
EMPTY_FORMULAS = rf"\${SPACE}*\$|={SPACE}{{2,}}[가-힣]|[가-힣]{SPACE}{{2,}}이[다라]?(?=[A-Za-z0-9_])"
LEAST_CHOICES, LEAST_UNITS, LEAST_FORMULAS, LEAST_LINES = 3, 3, 5, 10
TINY, TINY_SHARE, DAMAGED = 3, 0.25, 6


def damaged(text: Column) -> Column:
    """(hits, broken): hits of the patterns that count, with very short lines where they are many; null texts give nulls."""
    return bound(text, _damaged)


def _damaged(text: Column) -> Column:
    from_least = lambda least: lambda n: F.when(n >= least, n).otherwise(0)
    tiny = lambda lines: F.size(F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(SPACES))).between(1, TINY)))
    many = lambda n, lines: F.when((n >= LEAST_LINES) & (n > TINY_SHARE * F.size(lines)), n).otherwise(0)
    counted = [bound(F.split(text, "\n", -1), lambda lines: bound(tiny(lines), lambda n: many(n, lines)))]
    for pattern, least in [(EMPTY_CHOICES, LEAST_CHOICES), (EMPTY_UNITS, LEAST_UNITS), (EMPTY_FORMULAS, LEAST_FORMULAS)]:
        counted.append(bound(F.regexp_count(text, F.lit(pattern)), from_least(least)))
    struct = lambda hits: F.struct(F.when(text.isNotNull(), hits).alias("hits"), F.when(text.isNotNull(), hits >= DAMAGED * F.greatest(F.length(text) / 1000, F.lit(1.0))).alias("broken"))
    return bound(sum(counted[1:], counted[0]), struct)
