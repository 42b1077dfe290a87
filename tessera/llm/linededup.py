"""Line dedup: maximal runs of repeated lines by a suffix array over line ids, with DataFrame functions only.

A document is the sequence of its lines that hold a word, a line id being the hash of the line.  Prefix doubling
ranks all suffixes by their first 1, 2, 4, ... lines: the rank of twice the length is the place, in a distributed
sort of the distinct pairs, of (own rank, rank that many lines on).  Only suffixes whose prefix occurs elsewhere
are kept from round to round, and rounds end when no window below needs longer prefixes.

The interval of the suffix array in which all suffixes share a prefix of n lines is named by n and the ranks of
two prefixes of the largest power of two that cover it.  A run that repeats with at least min_words words is the
union of the shortest windows of that many words that start or that end at its lines, so these windows' intervals
give all maximal repeated runs.  The first copy of a window stays, the lines of later copies go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_counted, materialize, unused
from .quality import SPACE, WORD

#: Words from which a repeated run of lines is deleted.
MIN_WORDS = 50


def line_table(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line, at, id, words): lines with a word, at counting them from 0 in each row."""
    lines = docs.select("row", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "s")).where(F.col("s").rlike(WORD))
    words = F.size(F.filter(F.split("s", SPACE), lambda w: w != ""))
    hashed = lines.select("row", "doc_id", "line", F.xxhash64("s").alias("id"), words.cast("long").alias("words"))
    return hashed.withColumn("at", (F.row_number().over(W.partitionBy("row").orderBy("line")) - 1).cast("long"))


def _ranked(suffixes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """suffixes whose keys occur at least twice, with the keys' place in their sorted order as column name."""
    twice = suffixes.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    ranks = materialize(twice.orderBy(*keys).withColumn(name, F.monotonically_increasing_id()), "order")
    return join_counted(suffixes, ranks, keys, "_n", ranks.agg(F.sum("_n")).first()[0] or 0)


def _ahead(name: str, by: int) -> Column:
    """The value of name that many lines further on in the same row, if that suffix is still held."""
    return F.max(name).over(W.partitionBy("row").orderBy("at").rangeBetween(by, by))


def _windows(held: DataFrame, min_words: int) -> DataFrame:
    """(row, doc_id, start, n): shortest windows of at least min_words words that start, or that end, at a line.

    Windows lie within stretches of held lines, as a line that occurs once is in no repeated run.
    """
    by_row = W.partitionBy("row").orderBy("at")
    gap = (F.col("at") - F.lag("at").over(by_row) > 1).cast("int")
    stretch = held.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("stretch", F.sum("gap").over(by_row))
    w = W.partitionBy("row", "stretch")
    stretch = stretch.withColumn("upto", F.sum("words").over(w.orderBy("at")))
    begins = F.struct(F.lit(0).alias("kind"), (F.col("upto") - F.col("words")).alias("p"))
    ends = F.struct(F.lit(1).alias("kind"), F.col("upto").alias("p"))
    points = stretch.select("row", "doc_id", "stretch", "at", F.inline(F.array(begins, ends)))
    far = (W.unboundedPreceding, -min_words)
    near = points.withColumns(
        {
            "end": F.min(F.when(F.col("kind") == 1, F.col("at"))).over(w.orderBy(F.desc("p")).rangeBetween(*far)),
            "start": F.max(F.when(F.col("kind") == 0, F.col("at"))).over(w.orderBy("p").rangeBetween(*far)),
        }
    )
    begun = near.where("kind = 0 AND end IS NOT NULL").select("row", "doc_id", F.col("at").alias("start"), (F.col("end") - F.col("at") + 1).alias("n"))
    ended = near.where("kind = 1 AND start IS NOT NULL").select("row", "doc_id", "start", (F.col("at") - F.col("start") + 1).alias("n"))
    return begun.union(ended).distinct()


def _intervals(held: DataFrame, windows: DataFrame) -> DataFrame | None:
    """windows with the interval of the suffix array that they lie in: (n, a, b); None if there is no window.

    Windows whose prefixes occur once are left out.
    """
    longest = windows.agg(F.max("n")).first()[0] or 0
    ranks, named, level = held.select("row", "at", F.col("r0").alias("r")), None, 0
    while longest >> level:
        size = 1 << level
        mine = windows.where((F.col("n") >= size) & (F.col("n") < 2 * size)).withColumn("tail", F.col("start") + F.col("n") - size)
        first = mine.join(ranks.select("row", F.col("at").alias("start"), F.col("r").alias("a")), ["row", "start"])
        part = first.join(ranks.select("row", F.col("at").alias("tail"), F.col("r").alias("b")), ["row", "tail"])
        named = part if named is None else named.unionByName(part)
        if longest >> level > 1:
            pairs = ranks.withColumn("s", _ahead("r", size)).where("s IS NOT NULL")
            ranks = materialize(_ranked(pairs, ["r", "s"], "q").select("row", "at", F.col("q").alias("r")), "ranks")
        level += 1
    return named


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, line): lines of later copies of repeated runs; docs has row (unique), doc_id and text.

    Copies are ordered by doc_id (nulls last), then row, then line.
    """
    lines = materialize(line_table(docs), "lines")
    held = materialize(_ranked(lines, ["id"], "r0").select("row", "doc_id", "line", "at", "words", "r0"), "suffixes")
    windows = materialize(_windows(held, min_words), "windows")
    named = _intervals(held, windows)
    if named is None:
        return held.where("false").select("row", "line")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "start")
    named = materialize(named.withColumn("place", place), "intervals")
    firsts = materialize(named.groupBy("n", "a", "b").agg(F.min("place").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "firsts")
    later = join_counted(named, firsts, ["n", "a", "b"], "copies", firsts.agg(F.sum("copies")).first()[0] or 0).where("place > first")
    spans = later.groupBy("row", "start").agg(F.max("n").alias("n"))
    gone = spans.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct()
    return gone.join(held.select("row", "at", "line"), ["row", "at"]).select("row", "line")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "lines_removed") -> DataFrame:
    """docs with the lines of later copies of repeated runs deleted from text; their number is column removed.

    Runs of lines with at least min_words words that occur earlier, in the order of doc_id and line, are deleted;
    lines without a word stay as they are.  Null texts stay null; empty tables give empty results; repeated rows
    are copies like any other.  A text whose lines all go is empty.  A column of docs called like removed is replaced; further
    columns stay, whatever their names.
    """
    own, cut, parts = (unused(docs.columns, c) for c in ("_row", "_gone", "_lines"))
    rows = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "documents")
    gone = repeated_lines(rows.select(F.col(own).alias("row"), "doc_id", "text"), min_words)
    gone = materialize(gone.groupBy(F.col("row").alias(own)).agg(F.collect_list("line").alias(cut)), "gone")
    # merged at every size: what goes grows with the documents, so it is never broadcast
    lines = rows.join(gone.hint("merge"), own, "left").withColumn(parts, F.when(F.col(cut).isNotNull(), F.split("text", "\n")))
    keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(cut))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(F.col(parts), i)), "\n"))
    out = lines.withColumns({"text": text, removed: F.coalesce(F.size(cut), F.lit(0)).cast("long")})
    return out.select(*[c for c in docs.columns if c.lower() != removed.lower()], removed)
