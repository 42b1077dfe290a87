"""Layout of pages: pieces of text in reading order become numbered segments, which are merged and split.

Pieces have page, place (their place from 0), the box x0 y0 x1 y1 (null without one), chars (length of the trimmed text),
question and answer (the number that the text starts a question or an answer with), and kind.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .folds import ordered_fold

# Kinds of line that start no question; limits of place and number
NO_START = ["equation_number", "page_info", "x_axis_tick_label", "y_axis_tick_label"]
RIGHTMOST, LEAST_GAP, GAP_SHARE = 0.68, 16, 0.012
MOST_AHEAD, WRAP_FROM, WRAP_TO = 8, 20, 3
MOST_SEGMENTS, MOST_NUMBERED, TINY_LINES, TINY_CHARS = 20, 2, 2, 45
OVERLAP = 0.75


def _follows(number: int, before: int | None) -> bool:
    """Whether a question's number may come after that one: upwards by MOST_AHEAD at most, or anew after a long run."""
    if before is None:
        return True
    again = before >= WRAP_FROM and number <= WRAP_TO
    return number != before and (number > before or again) and number - before <= MOST_AHEAD


def segments(pieces: DataFrame, width: int, height: int) -> DataFrame:
    """pieces with segment (from 0) and printed, the number that its segment starts with.

    A piece starts a segment if it may hold a question's number, lies low enough below the last start, and its number
    follows the last one's.  What comes before the first number goes with it; a page of too many segments is one.
    """
    gap = max(LEAST_GAP, int(height * GAP_SHARE))
    may = (F.col("chars") > 0) & F.col("question").isNotNull() & F.col("y0").isNotNull() & ~F.col("kind").isin(NO_START) & (F.col("x0") <= int(width * RIGHTMOST))

    def step(state: tuple | None, row: dict[str, Any]) -> tuple[tuple, tuple]:
        starts, before, top = state or (0, None, None)
        if row["_may"] and (top is None or row["y0"] - top >= gap) and _follows(row["question"], before):
            starts, before, top = starts + 1, row["question"], row["y0"]
        return (starts, before, top), (starts, before)

    found = ordered_fold(pieces.withColumn("_may", F.coalesce(may, F.lit(False))), ["page"], ["place"], step, "_starts long, _number long", ["_may", "y0", "question"]).drop("_may")
    page = W.partitionBy("page")
    # the pieces before the first number are of segment 0 on a page without numbers, else of the first
    after = F.greatest(F.col("_starts") - 1, F.lit(0))
    number = F.when(F.col("_starts") > 0, F.col("_number"))
    first = F.min(F.when(F.col("_starts") == 1, F.col("_number"))).over(page)
    number = F.when(F.max("_starts").over(page) > MOST_SEGMENTS, first).when(F.col("_starts") == 0, first).otherwise(number)
    segment = F.when(F.max("_starts").over(page) > MOST_SEGMENTS, 0).otherwise(after)
    return found.withColumns({"segment": segment.cast("long"), "printed": number}).drop("_starts", "_number")


def merged_forward(found: DataFrame) -> DataFrame:
    """(page, segment, merged, printed): tiny segments, and what they have become with those before, join the next one.

    Only on pages with few numbered segments.  printed is the first number of what has been merged so far.
    """
    page = W.partitionBy("page")
    sizes = found.groupBy("page", "segment").agg(F.count_if(F.col("chars") > 0).alias("lines"), F.sum("chars").alias("chars"), F.max("printed").alias("own"))
    sizes = sizes.withColumns({"_last": F.max("segment").over(page), "_numbered": F.count("own").over(page)})

    def step(state: tuple | None, row: dict[str, Any]) -> tuple[tuple, tuple]:
        merged, lines, chars, printed, more, joins = state or (-1, 0, 0, None, 0, False)
        if joins:
            more += printed is not None and row["own"] is None  # the one before still counts beside what it joins
            lines, chars, printed = lines + row["lines"], chars + row["chars"], row["own"] if printed is None else printed
        else:
            merged, lines, chars, printed = merged + 1, row["lines"], row["chars"], row["own"]
        tiny = lines <= TINY_LINES or chars < TINY_CHARS
        joins = tiny and row["_numbered"] + more <= MOST_NUMBERED and row["segment"] < row["_last"]
        return (merged, lines, chars, printed, more, joins), (merged, printed)

    return ordered_fold(sizes, ["page"], ["segment"], step, "merged long, printed long").select("page", "segment", "merged", "printed")


def _named(order: str) -> Column:
    """The first answer's or question's number in the order, for groupings."""
    number = F.when(F.col("chars") > 0, F.coalesce("answer", "question"))
    return F.min_by(number, F.when(number.isNotNull(), F.col(order)))


def split_at_answers(found: DataFrame, merged: DataFrame) -> DataFrame:
    """Pieces with part (from 0 in the page) and printed: merged segments, cut where another question's answer begins.

    The owner of a segment is its printed number or else the first number in it; after a cut it is the answer's number.
    """
    ends = merged.groupBy("page", "merged").agg(F.max_by("printed", "segment").alias("printed"))
    joined = found.drop("printed").join(merged.select("page", "segment", "merged"), ["page", "segment"]).join(ends, ["page", "merged"])
    answer = F.when(F.col("chars") > 0, F.col("answer"))
    whole = W.partitionBy("page", "merged")
    by = whole.orderBy("place")
    number = F.when(F.col("chars") > 0, F.coalesce("answer", "question"))
    inner = F.row_number().over(by) > 1
    owner = F.coalesce("printed", F.first(number, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    seen = joined.withColumns({"_answer": F.when(inner, answer), "_owner": owner})
    current = F.coalesce(F.last("_answer", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)), "_owner")
    cut = seen.withColumn("_cut", F.coalesce(F.col("_answer") != current, F.lit(False)).cast("int"))
    cut = cut.withColumn("_chunk", F.sum("_cut").over(by)).withColumn("_chunks", F.max("_chunk").over(whole))
    first = F.first(number, ignorenulls=True).over(W.partitionBy("page", "merged", "_chunk").orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    printed = F.when(F.col("_chunks") > 0, F.coalesce(first, "printed")).otherwise(F.col("printed"))
    part = F.dense_rank().over(W.partitionBy("page").orderBy("merged", "_chunk")) - 1
    return cut.withColumns({"part": part.cast("long"), "printed": printed}).drop("_answer", "_owner", "_cut", "_chunk", "_chunks", "merged")


def overlap(a: tuple | None, b: tuple | None) -> float:
    """Intersection over union of two boxes; areas are 1 at least."""
    if a is None or b is None:
        return 0.0
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if wide <= 0 or high <= 0:
        return 0.0
    area = [max(1, (x[2] - x[0]) * (x[3] - x[1])) for x in (a, b)]
    return wide * high / (sum(area) - wide * high)


def merged_owners(parts: DataFrame, boxless: bool = False) -> DataFrame:
    """(page, part, merged, owner): a part joins the one before if both have the same owner and their boxes overlap.

    The box before is that of all parts merged into it so far.  A part without a box joins nothing; with boxless it counts
    as lying within the other's box.
    """
    boxes = parts.groupBy("page", "part").agg(F.coalesce(F.max("printed"), _named("place")).alias("owner"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])

    def step(state: tuple | None, row: dict[str, Any]) -> tuple[tuple, tuple]:
        merged, owner, box = state or (-1, None, None)
        own = None if row["x0"] is None else (row["x0"], row["y0"], row["x1"], row["y1"])
        inside = boxless and (box is None) != (own is None)
        if state and owner is not None and owner == row["owner"] and overlap(*([box or own] * 2 if inside else [box, own])) >= OVERLAP:
            box = (box or own) if inside else (*map(min, box[:2], own[:2]), *map(max, box[2:], own[2:]))
        else:
            merged, owner, box = merged + 1, row["owner"], own
        return (merged, owner, box), (merged,)

    return ordered_fold(boxes, ["page"], ["part"], step, "merged long").select("page", "part", "merged", "owner")
