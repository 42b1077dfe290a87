"""Joins that deal hot keys over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds more than a HOT_KEYS-th of all rows is dealt; there can't be more of them.
HOT_KEYS = 1_024


#: Rows of the tokens of queries that are broadcast.
BROADCAST_ROWS = 1_000_000


def few(asked: DataFrame) -> bool:
    """Whether asked has so few rows that it may go to every task."""
    return asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def by_document(asked: DataFrame) -> DataFrame:
    """asked, marked to be broadcast if it has few rows, so that a join leaves the other side dealt as it is."""
    return F.broadcast(asked) if few(asked) else asked


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """The inner join of rows with keyed, a table of one row a key that holds in count how many rows have that key.

    A key with more than a HOT_KEYS-th of the total rows is dealt over as many parts as it has such shares, by the
    hash of the row, so no task gets all its rows.  At most HOT_KEYS keys are dealt, and only they are broadcast, with
    their numbers of parts.  Null keys match nothing; count is dropped.
    """
    parted = keyed.withColumn("_parts", F.ceil(F.col(count) / max(1, total // HOT_KEYS)).cast("int")).drop(count)
    often = F.broadcast(parted.where("_parts > 1").select(*keys, "_parts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int"), F.lit(0))
    dealt = rows.join(often, keys, "left").withColumn("_part", salt).drop("_parts")
    each = parted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(each, [*keys, "_part"]).drop("_part")
