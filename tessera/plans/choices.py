"""Queries that choose among rows or keys: preferences, what remains, what stays of duplicates, diagnoses."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .registry import query

#: Statuses of a row, the preferred first.
PREFERRED = ("F", "O", "P")
RANK = "CASE o_orderstatus " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(PREFERRED)) + f" ELSE {len(PREFERRED)} END"


@query(f"""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {RANK}, o_orderkey) AS r FROM orders) WHERE r = 1""")
def preferred_per_key(read):
    rank = F.coalesce(*[F.when(F.col("o_orderstatus") == s, i) for i, s in enumerate(PREFERRED)], F.lit(len(PREFERRED)))
    best = F.min(F.struct(rank.alias("rank"), "o_orderkey", "o_orderstatus")).alias("best")  # combined before the shuffle
    return read("orders").groupBy("o_custkey").agg(best).select("o_custkey", "best.o_orderkey", "best.o_orderstatus")


@query("""SELECT coalesce(k, o_custkey) AS number, k IS NOT NULL AS named, coalesce(n, 0) AS n FROM (SELECT CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS k FROM customer)
FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON k = o_custkey""")
def matched_numbers(read):
    named = read("customer").select(F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long").alias("k"))
    used = read("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    both = named.join(used, F.col("k") == F.col("o_custkey"), "full")
    return both.select(F.coalesce("k", "o_custkey").alias("number"), F.col("k").isNotNull().alias("named"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def remaining_keys(read):
    done = read("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read("customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT min(doc_id) AS stays, count(*) - 1 AS dropped, max(length(text)) AS size FROM documents GROUP BY sha256(text) HAVING count(*) > 1""")
def duplicate_texts(read):
    groups = read("documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("stays"), (F.count("*") - 1).alias("dropped"), F.max(F.length("text")).cast("long").alias("size"))
    return groups.where("dropped > 0").drop("sha")


@query("""SELECT p_brand, CAST(median(p_size) AS DOUBLE) AS size, count(*) AS n FROM part GROUP BY 1""")
def group_medians(read):
    return read("part").groupBy("p_brand").agg(F.median("p_size").cast("double").alias("size"), F.count("*").alias("n"))


@query("""SELECT source, count(*) AS n, CAST(sum((length(coalesce(text, '')) + 3) // 4) AS BIGINT) AS tokens FROM documents GROUP BY 1""")
def estimated_tokens(read):
    size = F.length(F.coalesce("text", F.lit("")))
    return read("documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.floor((size + 3) / 4)).alias("tokens"))


@query("""SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0 ORDER BY s_acctbal, s_suppkey LIMIT 10""")
def lowest_rated(read):
    return read("supplier").where("s_acctbal < 0").orderBy("s_acctbal", "s_suppkey").limit(10).select("s_suppkey", "s_acctbal")


TOTALS = "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value IS NULL) AS unpriced, count(DISTINCT user_id) AS users FROM events"
#: Diagnoses of a table of usage, each a condition over its totals.
DIAGNOSES = {"many_failures": "failed > 0.1 * n", "unpriced_calls": "unpriced > 0", "few_users": "users < 10", "heavy_users": "n > 50 * users", "no_usage": "n = 0"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS diagnosis FROM ({TOTALS}) WHERE {rule}" for name, rule in DIAGNOSES.items()))
def usage_diagnoses(read):
    totals = read("events").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value").isNull()).alias("unpriced"), F.countDistinct("user_id").alias("users"))
    found = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in DIAGNOSES.items()]))
    return totals.select(F.explode(found).alias("diagnosis"))


@query("""SELECT event_type, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r <= 3""")
def heaviest_users(read):
    counts = read("events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    r = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))
    return counts.withColumn("r", r).where("r <= 3").drop("r")
