"""Operators over usage logs: rollups, alarms, summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MONEY = "decimal(18,4)"


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rollup_costs(calls: DataFrame, keys: list[str], cost: str) -> DataFrame:
    """Calls and cost by every prefix of keys, the grand total included; level counts the keys of a row."""
    out = calls.rollup(*keys).agg(F.count("*").alias("calls"), F.sum(F.col(cost).cast(MONEY)).alias("cost"), F.grouping_id().alias("_g"))
    return out.withColumn("level", (len(keys) - F.bit_count("_g")).cast("int")).drop("_g")


def daily(calls: DataFrame, at: str, share: float = 0.5) -> DataFrame:
    """Calls by UTC day, null times dropped, with the estimate ceil(calls * share)."""
    return calls.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("calls")).withColumn("estimate", F.ceil(F.col("calls") * share).cast("long"))


def trailing(events: DataFrame, at: str, hours: int) -> DataFrame:
    """Rows of the last hours before the latest time of the table."""
    last = events.agg(F.max(at).alias("_last"))
    return events.crossJoin(F.broadcast(last)).where(F.col(at) >= F.col("_last") - F.expr(f"INTERVAL {hours} HOURS")).drop("_last")


def alarm(runs: DataFrame, ok: str, attempts: str, least: int = 5, high: float = 0.3) -> DataFrame:
    """Runs, failures, failure rate and share of retries among attempts (null and 0 attempts count as 1)."""
    a = F.when(F.coalesce(F.col(attempts), F.lit(0)) == 0, 1).otherwise(F.col(attempts))
    sums = runs.agg(F.count("*").alias("runs"), F.count_if(F.col(ok) == F.lit(False)).alias("failed"), F.sum(a - 1).alias("_r"), F.sum(a).alias("_a"))
    rate = ratio(F.col("failed"), F.col("runs"))
    return sums.select("runs", "failed", F.round(rate, 4).alias("failure_rate"), F.round(ratio(F.col("_r"), F.col("_a")), 4).alias("retry_share"), ((F.col("runs") >= least) & (rate >= high)).alias("alarm"))


def run_summary(runs: DataFrame, by: list[str], ok: str, rating: str) -> DataFrame:
    """Success and failure (null is neither, but counts in the rate), mean of known ratings, low ratings."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_if(F.col(ok)).alias("succeeded"), F.count_if(~F.col(ok)).alias("failed"),
        F.round(ratio(F.count_if(F.col(ok)), F.count("*")), 4).alias("success_rate"), F.count(rating).alias("rated"),
        F.round(F.avg(rating), 4).alias("mean_rating"), F.count_if(F.col(rating) <= 2).alias("low_rated"),
    )


def label_by_dimension(facts: DataFrame, labels: dict[str, str], key: str) -> DataFrame:
    """Label of a key from a literal dimension, else the key, else 'unknown'."""
    dim = facts.sparkSession.createDataFrame(list(labels.items()), f"{key} string, _label string")
    return facts.join(F.broadcast(dim), key, "left").withColumn("label", F.coalesce(F.nullif("_label", F.lit("")), F.nullif(key, F.lit("")), F.lit("unknown"))).drop("_label")


def price_of(name: Column, prices: list[tuple[str, float]], default: float) -> Column:
    """The price of the name itself, else of the first listed key that it contains, else the default."""
    exact = [F.when(name == k, F.lit(p)) for k, p in prices]
    part = [F.when(F.contains(F.lower(name), F.lit(k.lower())), F.lit(p)) for k, p in prices]
    return F.coalesce(*exact, *part, F.lit(default))


def ratio_to_max(groups: DataFrame, by: list[str], value: str) -> DataFrame:
    """value over the largest value of its partition."""
    return groups.withColumn("ratio", F.round(F.col(value) / F.max(value).over(W.partitionBy(*by)), 4))


def local_day(at: Column, zone: str = "Asia/Seoul") -> Column:
    """The day in a time zone of a UTC time as text; null gives 0000-00-00."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(at.cast("timestamp"), zone), "yyyy-MM-dd"), F.lit("0000-00-00"))
