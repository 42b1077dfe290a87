"""Markup as an ordered sequence of typed items, by one pattern that takes all kinds in the order of the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities and what they stand for, in the order in which they are replaced
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")]
FIGURE = "[FIGURE]"


def decoded(text: Column) -> Column:
    """The five entities of XML, replaced in a fixed order."""
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def items(text: Column, run: str = "CHAR", formula: str = "EQUATION", script: str = "SCRIPT", picture: str = "PICTURE") -> Column:
    """(kind, value) of a document's runs of text (T, decoded), formulas (E, trimmed) and pictures (P), in their order.

    A run has text and no markup in it; a formula's value is what its script element holds.  Null gives null.
    """
    runs, formulas, pictures = rf"<{run}[^>]*>([^<]+)</{run}>", rf"<{formula}[^>]*>.*?<{script}>(.*?)</{script}>.*?</{formula}>", rf"<{picture}[^>]*>"
    found = F.regexp_extract_all(text, F.lit(rf"(?s){runs}|{formulas}|{pictures}"), F.lit(0))

    def item(one: Column) -> Column:
        is_run, is_formula = one.rlike(rf"(?s)\A{runs}\z"), one.rlike(rf"(?s)\A{formulas}\z")
        kind = F.when(is_run, "T").when(is_formula, "E").otherwise("P")
        body = F.regexp_replace(F.regexp_extract(one, rf"(?s)<{script}>(.*?)</{script}>", 1), r"^\s+|\s+$", "")
        value = F.when(is_run, decoded(F.regexp_extract(one, rf"(?s)\A{runs}\z", 1))).when(is_formula, body).otherwise(FIGURE)
        return F.struct(kind.alias("kind"), value.alias("value"))

    return F.transform(found, item)
