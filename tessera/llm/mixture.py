"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets are min(cap, level * weight), the cap being a source's size times the most epochs.  The level starts at the
wanted words by weight; each round clamps the sources above their caps and deals the rest by the weights of the others,
until none is above: one row of sums a round, in whole numbers.

A source takes all its documents as often as its target holds its size.  What is left goes to documents in the order of
a seeded digest of id and text, up to the one at which the target lies, which gives the words still missing.  That place
is found by two rounds of sums over prefixes of the digest, so no task sorts a source.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.positions import numbered
from .common import join_counted, materialize
from .quality import WORD

WEIGHTS, PERCENT, EPOCHS = (3, 1, 2), 150, 2
#: Hex digits of the digest: of the two rounds of sums, and in all.
DIGITS, DIGEST = (3, 6), 16
KEYS = ["named", "label"]


def _decimal(value: int) -> Column:
    return F.lit(Decimal(value)).cast("decimal(38,0)")


def targets(sizes: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """sizes (size, weight and other columns, a row a source) with target (double) and goal (its whole words).

    Capped sources get exactly epochs * size.  If percent asks for more than all caps give, all are capped.
    """
    cap = F.col("size") * epochs
    weights, left = (int(x or 0) for x in sizes.agg(F.sum("weight"), F.sum("size") * percent).first())
    asked = left
    while True:  # the level is left / (100 * weights); it only rises, so each round clamps one more source or is the last
        above = cap.cast("decimal(19,0)") * _decimal(100 * weights).cast("decimal(18,0)") <= F.col("weight").cast("decimal(4,0)") * _decimal(left).cast("decimal(33,0)")
        clamped, open_ = (int(x or 0) for x in sizes.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first())
        if open_ == weights or not open_:
            break
        weights, left = open_, asked - 100 * clamped
    share = F.col("weight").cast("decimal(4,0)") * _decimal(left).cast("decimal(33,0)")
    if not weights:  # no sources
        return sizes.withColumns({"target": cap.cast("double"), "goal": cap})
    by_weight = share.cast("double") / F.lit(float(100 * weights))
    goal = F.call_function("div", share, _decimal(100 * weights))
    return sizes.withColumns({"target": F.when(above, cap.cast("double")).otherwise(by_weight), "goal": F.when(above, cap).otherwise(goal)})


def _boundary(sums: DataFrame, at: str, size: str) -> DataFrame:
    """Of each source's rows in the order of at the one in which its rest ends, and the rest before it in rest.

    Sources whose rest is 0 have none.
    """
    before = F.sum(size).over(W.partitionBy(*KEYS).orderBy(at)) - F.col(size)
    return sums.withColumn("before", before).where(f"before < rest AND rest <= before + {size}").withColumn("rest", F.col("rest") - F.col("before")).drop("before")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = 13) -> DataFrame:
    """(doc_id, size, source_size, target, whole, part, taken): how much of each row the mix takes.

    size is the number of words of the text (null: none); sources, in the order of code points and null last, have the
    weights in turn.  A row is taken whole times and then its first part words; taken counts all of these words.  Equal
    rows at the place where a source's target lies share what is missing there, so the sum of a source is below its
    target by less than their number, 1 in general.  The same rows give the same result, in whatever order they come.
    Sources without words and empty tables take nothing.  Further columns are not read.
    """
    text, source = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("source").cast("string")
    doc_id = F.col("doc_id").cast("long")
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)), 1, DIGEST)
    rows = docs.select(doc_id.alias("doc_id"), source.isNotNull().alias("named"), F.coalesce(source, F.lit("")).alias("label"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), digest.alias("digest"))
    rows = materialize(rows.withColumn("own", F.monotonically_increasing_id()), "mix-rows")

    # equal rows are one unit from here on, so a group of copies of any size is one row
    units = materialize(rows.groupBy(*KEYS, "digest", "doc_id", "size").agg(F.count("*").alias("rows")).withColumn("words", F.col("size") * F.col("rows")), "mix-units")
    sizes = units.groupBy(*KEYS).agg(F.sum("words").alias("size"), F.sum("rows").alias("rows"))
    places = numbered(sizes, [F.desc("named"), "label"], "place", lambda d: materialize(d, "mix-sources"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = targets(places.withColumn("weight", weight.cast("long")).drop("place"), percent, epochs)
    whole = F.when(F.col("size") > 0, F.call_function("div", F.col("goal"), F.col("size"))).otherwise(0).cast("long")
    sources = sources.select(*KEYS, "rows", F.col("size").alias("source_size"), "target", whole.alias("whole"), (F.col("goal") - whole * F.col("size")).alias("rest"))
    sources = materialize(sources, "mix-targets")

    prefix = lambda n: F.substring("digest", 1, n)
    coarse = units.groupBy(*KEYS, prefix(DIGITS[0]).alias("coarse")).agg(F.sum("words").alias("words"))
    cut = _boundary(coarse.join(sources.select(*KEYS, "rest"), KEYS), "coarse", "words").drop("words")
    fine = units.withColumns({"coarse": prefix(DIGITS[0]), "fine": prefix(DIGITS[1])}).groupBy(*KEYS, "coarse", "fine").agg(F.sum("words").alias("words"))
    cut = _boundary(fine.join(cut, [*KEYS, "coarse"]), "fine", "words").select(*KEYS, "fine", "rest")
    order = F.struct("digest", F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), "size")
    last = units.withColumn("fine", prefix(DIGITS[1])).join(cut, [*KEYS, "fine"]).withColumn("at", order)
    last = _boundary(last, "at", "words").select(*KEYS, F.col("at").alias("end"), F.call_function("div", F.col("rest"), F.col("rows")).alias("some"))
    ends = materialize(sources.drop("rest").join(last, KEYS, "left"), "mix-ends")

    n_rows = ends.agg(F.sum("rows")).first()[0] or 0
    placed = join_counted(rows, ends, KEYS, "rows", n_rows).withColumn("at", order)
    part = F.when(F.col("at") < F.col("end"), F.col("size")).when(F.col("at") == F.col("end"), F.col("some")).otherwise(0).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", "whole", part.alias("part"), (F.col("whole") * F.col("size") + part).alias("taken"))


#: The rows of op13 by DuckDB.
SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, substr(md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {DIGEST}) AS digest FROM documents),
z AS (SELECT source, CAST(sum(size) AS HUGEINT) AS size FROM d GROUP BY 1),
s AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS HUGEINT) AS w FROM z),
fill AS (SELECT 0 AS round, {PERCENT} * sum(size) AS left_, sum(w) AS weights FROM s UNION ALL SELECT round + 1, {PERCENT} * words - 100 * clamped, free FROM
    (SELECT round, left_, weights, sum(size) AS words, sum(CASE WHEN {EPOCHS} * size * 100 * weights <= w * left_ THEN {EPOCHS} * size ELSE 0 END) AS clamped, sum(CASE WHEN {EPOCHS} * size * 100 * weights > w * left_ THEN w END) AS free
    FROM fill, s GROUP BY round, left_, weights) WHERE free <> weights),
l AS (SELECT left_, weights FROM fill ORDER BY round DESC LIMIT 1),
t AS (SELECT source, size AS source_size, {EPOCHS} * size * 100 * weights <= w * left_ AS capped, CASE WHEN capped THEN {EPOCHS} * size ELSE w * left_ // (100 * weights) END AS goal, CASE WHEN capped THEN CAST({EPOCHS} * size AS DOUBLE) ELSE CAST(w * left_ AS DOUBLE) / CAST(100 * weights AS DOUBLE) END AS target FROM s, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN goal % source_size ELSE 0 END AS rest FROM t),
u AS (SELECT source, digest, doc_id, size, count(*) AS n, sum(size) AS words FROM d GROUP BY 1, 2, 3, 4),
p AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY digest, doc_id NULLS LAST, size) - words AS before FROM u)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(whole AS BIGINT) AS whole,
    CAST(CASE WHEN before + words <= rest THEN d.size WHEN before >= rest THEN 0 ELSE (rest - before) // n END AS BIGINT) AS part,
    CAST(whole * d.size + CASE WHEN before + words <= rest THEN d.size WHEN before >= rest THEN 0 ELSE (rest - before) // n END AS BIGINT) AS taken
FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source JOIN p ON p.source IS NOT DISTINCT FROM d.source AND p.digest = d.digest AND p.doc_id IS NOT DISTINCT FROM d.doc_id AND p.size = d.size"""
