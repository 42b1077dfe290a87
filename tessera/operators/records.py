"""Operators over numbered records in series: integrity checks, pairing, snapshots, incremental tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .positions import numbered


def keep_longest(rows: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """One row per key: the longest text, the first in order among equals."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.length(text)), *order))
    return rows.withColumn("_r", r).where("_r = 1").drop("_r")


def keep_latest(rows: DataFrame, keys: list[str], at: str, order: list[str]) -> DataFrame:
    """One row per key: the latest, the first in order among equals; null times last."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(at), *order))
    return rows.withColumn("_r", r).where("_r = 1").drop("_r")


def gaps(rows: DataFrame, series: str, number: str, least: int = 3, most_missing: float = 0.5) -> DataFrame:
    """Numbers missing between the least and the largest of a series with enough known ones."""
    known = rows.where(F.col(number).isNotNull()).groupBy(series).agg(F.collect_set(number).alias("_k"), F.min(number).alias("_a"), F.max(number).alias("_b"))
    # the share is known from the counts, so the numbers between are made only where they are few
    span = F.col("_b").cast("decimal(20,0)") - F.col("_a") + 1
    absent = span - F.size("_k")
    few = (F.size("_k") >= least) & (absent > 0) & (absent < span * most_missing)
    missing = F.when(few, F.array_sort(F.array_except(F.sequence("_a", "_b"), "_k")))
    return known.withColumn("missing", missing).where(F.col("missing").isNotNull()).select(series, "missing")


def duplicates(rows: DataFrame, keys: list[str], source: str, samples: int = 3) -> DataFrame:
    """Keys that occur at least twice, with their count and the first distinct sources."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(source)), 1, samples).alias("sources")).where("n >= 2")


def adjacent_distinct(rows: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before (null equals null); the first row stays."""
    w = W.partitionBy(*partition).orderBy(*order)
    marked = rows.withColumns({"_p": F.lag(value).over(w), "_n": F.row_number().over(w)})
    return marked.where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_p"))).drop("_p", "_n")


def merged_runs(rows: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of adjacent equal values: their number, value, length and place."""
    w = W.partitionBy(*partition).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).groupBy(*partition, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def pair_series(left: DataFrame, right: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """left with the longest text of right for the same key in column paired; rows without one stay."""
    best = keep_longest(right.where(F.coalesce(F.trim(text), F.lit("")) != ""), keys, text, order).select(*keys, F.col(text).alias("paired"))
    return left.join(best, keys, "left")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison by key: only_old, only_new, same or changed."""
    a, b = old.select(F.col(key).alias("a"), F.col(value).alias("x")), new.select(F.col(key).alias("b"), F.col(value).alias("y"))
    state = F.when(F.col("b").isNull(), "only_old").when(F.col("a").isNull(), "only_new").when(F.col("x").eqNullSafe(F.col("y")), "same").otherwise("changed")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def prune(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows whose key is present; all rows if nothing is present, as an empty listing is taken for a failed one."""
    some = present.select(F.lit(1).alias("_one")).limit(1)
    kept = rows.join(present.select(key).distinct(), key, "left_semi")
    return kept.unionByName(rows.join(F.broadcast(some), F.lit(True), "left_anti"))


def changed(files: DataFrame, state: DataFrame, key: str, at: str) -> DataFrame:
    """Files that the state lacks or knows with another time (null equals null)."""
    known = state.select(F.col(key).alias("_k"), F.col(at).alias("_t"))
    return files.join(known, (F.col(key) == F.col("_k")) & F.col(at).eqNullSafe(F.col("_t")), "left_anti")


def positional_fallback(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """value of right by key, else that of the row of right at the same place in the order; keys are unique in right."""
    a = numbered(left, [order], "_at").join(right.select(key, F.col(value).alias("_v")), key, "left")
    other = numbered(right.select(order, value), [order], "_at").select("_at", F.col(value).alias("_w"))
    return a.join(other, "_at", "left").withColumn(value, F.coalesce("_v", "_w")).drop("_at", "_v", "_w")


def archived(rows: DataFrame, name: list[str], stamp: str) -> DataFrame:
    """rows with archived: all versions of a name but the newest; null stamps are oldest, equal newest ones all stay.

    The newest stamp is joined back, so no task sorts the versions of a name.
    """
    newest = rows.groupBy(*name).agg(F.max(stamp).alias("_newest"))
    same = reduce(lambda a, b: a & b, [F.col(f"_{n}").eqNullSafe(F.col(n)) for n in name])
    newest = newest.select(*[F.col(n).alias(f"_{n}") for n in name], "_newest")
    return rows.join(newest, same).withColumn("archived", ~F.col(stamp).eqNullSafe(F.col("_newest"))).drop("_newest", *[f"_{n}" for n in name])


def assisted_pairing(plan: DataFrame, records: DataFrame, least: float = 0.6) -> DataFrame:
    """(series, no, problem, solution, filled, n): each series and number's longest problem and longest solution.

    plan has id, series, no, side (problem, solution or other) and confidence; records has id, chars and filled, whether
    the problem has a solution already.  Rows below the confidence, without a number or of another side do not count.
    Of equal lengths the smaller id is taken.  n is the number of rows that the pair was chosen from.
    """
    sure = plan.where((F.col("confidence") >= least) & F.col("no").isNotNull() & F.col("side").isin("problem", "solution"))
    rows = sure.join(records.select("id", "chars", "filled"), "id")
    best = lambda side: F.max_by(F.struct("id", "filled"), F.when(F.col("side") == side, F.struct(F.coalesce("chars", F.lit(0)).alias("c"), (-F.col("id")).alias("i"))))
    both = rows.groupBy("series", "no").agg(best("problem").alias("p"), best("solution").alias("s"), F.count_if(F.col("side") == "problem").alias("problems"), F.count("*").alias("n"))
    return both.where((F.col("problems") > 0) & (F.col("problems") < F.col("n"))).select("series", "no", F.col("p.id").alias("problem"), F.col("s.id").alias("solution"), F.col("p.filled").alias("filled"), "n")


def pairing_counts(plan: DataFrame, pairs: DataFrame) -> DataFrame:
    """(updated, skipped): pairs whose problem had no solution; rows that led to no pair, and one for each filled problem."""
    used = pairs.agg(F.count_if(~F.col("filled")).alias("updated"), F.count_if("filled").alias("full"), F.coalesce(F.sum("n"), F.lit(0)).alias("used"))
    return plan.agg(F.count("*").alias("all")).crossJoin(used).select("updated", (F.col("all") - F.col("used") + F.col("full")).alias("skipped"))
