"""Queries over records in series: order lines, the order as series and the line number as number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from .registry import query


@query("""SELECT series, missing FROM (SELECT l_orderkey AS series, list_sort(list_filter(generate_series(min(l_linenumber), max(l_linenumber)), lambda n: NOT list_contains(list(DISTINCT l_linenumber), CAST(n AS INTEGER)))) AS missing, count(DISTINCT l_linenumber) AS k, max(l_linenumber) - min(l_linenumber) + 1 AS span FROM lineitem GROUP BY 1)
WHERE k >= 3 AND len(missing) > 0 AND len(missing) / span < 0.5""".replace("SELECT series, missing FROM", "SELECT series, array_to_string(missing, ',') AS missing FROM"))
def series_gaps(read):
    return R.gaps(read("lineitem").withColumnRenamed("l_orderkey", "series"), "series", "l_linenumber").select("series", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, array_to_string(list_sort(list(DISTINCT l_shipmode))[1:3], ',') AS sources FROM (SELECT l_orderkey, l_linenumber, concat(l_returnflag, l_linestatus) AS l_shipmode FROM lineitem) GROUP BY 1, 2 HAVING count(*) >= 2""")
def series_duplicates(read):
    rows = read("lineitem").withColumn("source", F.concat("l_returnflag", "l_linestatus"))
    return R.duplicates(rows, ["l_orderkey", "l_linenumber"], "source").withColumn("sources", F.array_join("sources", ","))


@query("""SELECT l_suppkey, count(*) AS total, count(l_linenumber) AS numbered, count(*) FILTER (l_returnflag = 'R') AS paired, round(count(*) FILTER (l_returnflag = 'R') / count(*), 4) AS rate, min(l_linenumber) AS lowest, max(l_linenumber) AS highest, count(DISTINCT l_linenumber) AS numbers FROM lineitem GROUP BY 1""")
def series_statistics(read):
    n, paired = F.count("*"), F.count_if(F.col("l_returnflag") == "R")
    return read("lineitem").groupBy("l_suppkey").agg(n.alias("total"), F.count("l_linenumber").alias("numbered"), paired.alias("paired"), F.round(paired / n, 4).alias("rate"), F.min("l_linenumber").alias("lowest"), F.max("l_linenumber").alias("highest"), F.countDistinct("l_linenumber").alias("numbers"))


@query("""SELECT l_suppkey, problems, rate FROM (SELECT l_suppkey, count(*) AS problems, round(count(*) FILTER (l_returnflag = 'R') / count(*), 4) AS rate FROM lineitem GROUP BY 1) WHERE problems >= 5 AND rate < 0.4 ORDER BY rate, l_suppkey LIMIT 30""")
def worst_pairing(read):
    n = F.count("*")
    stats = read("lineitem").groupBy("l_suppkey").agg(n.alias("problems"), F.round(F.count_if(F.col("l_returnflag") == "R") / n, 4).alias("rate"))
    return stats.where("problems >= 5 AND rate < 0.4").orderBy("rate", "l_suppkey").limit(30)


@query("""SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS r FROM part) WHERE r = 1""")
def longest_per_key(read):
    return R.keep_longest(read("part"), ["p_brand"], "p_name", ["p_partkey"]).select("p_brand", "p_partkey", "p_name")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1""")
def latest_per_key(read):
    return R.keep_latest(read("orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM p""")
def adjacent_distinct(read):
    return R.adjacent_distinct(read("events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("""SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2""")
def merged_runs(read):
    return R.merged_runs(read("events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""SELECT n_nationkey, n_name, c_name AS paired FROM nation LEFT JOIN (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY length(c_name) DESC, c_custkey) AS r FROM customer WHERE c_mktsegment = 'BUILDING' AND trim(c_name) <> '') ON n_nationkey = c_nationkey AND r = 1""")
def paired_series(read):
    right = read("customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_nationkey", "n_nationkey")
    return R.pair_series(read("nation").select("n_nationkey", "n_name"), right, ["n_nationkey"], "c_name", ["c_custkey"])


@query("""SELECT coalesce(a, b) AS custkey, CASE WHEN b IS NULL THEN 'only_old' WHEN a IS NULL THEN 'only_new' WHEN x IS NOT DISTINCT FROM y THEN 'same' ELSE 'changed' END AS state FROM
(SELECT c_custkey AS a, c_mktsegment AS x FROM customer WHERE c_custkey % 7 <> 0) FULL OUTER JOIN (SELECT c_custkey AS b, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS y FROM customer WHERE c_custkey % 11 <> 0) ON a = b""")
def snapshot_diff(read):
    c = read("customer").withColumnRenamed("c_custkey", "custkey")
    new = c.where("custkey % 11 <> 0").withColumn("c_mktsegment", F.when(F.col("custkey") % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    return R.snapshot_diff(c.where("custkey % 7 <> 0"), new, "custkey", "c_mktsegment")


@query("""SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, s_name, CAST(0 AS DOUBLE) FROM supplier WHERE s_suppkey % 3 = 0""")
def upserted(read):
    s = read("supplier").select("s_suppkey", "s_name", "s_acctbal")
    return R.upsert(s, s.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.lit(0.0)), ["s_suppkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def pruned(read):
    return R.prune(read("orders").select("o_orderkey", "o_custkey"), read("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate IS NOT DISTINCT FROM o_orderdate)")
def changed_files(read):
    state = read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("o_orderdate"))
    return R.changed(read("orders"), state, "o_orderkey", "o_orderdate").select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' WHEN n < 3 THEN 'few' ELSE 'fine' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def file_status(read):
    counts = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_quantity") > 25).alias("n"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 0, "empty").when(F.col("n") < 3, "few").otherwise("fine")
    return read("orders").select("o_orderkey").join(counts, "o_orderkey", "left").select("o_orderkey", status.alias("status"))


@query("""SELECT p_brand, count(*) FILTER (p_size <= 10) AS small, count(*) FILTER (p_size > 10 AND p_size <= 25) AS medium, count(*) FILTER (p_size > 25) AS large FROM part GROUP BY 1""")
def size_histogram(read):
    bucket = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 25, "medium").otherwise("large")
    return read("part").withColumn("b", bucket).groupBy("p_brand").pivot("b", ["small", "medium", "large"]).count().na.fill(0)
