"""Queries over usage: events as calls (event_type as route, the user's last digit as model, value as cost), orders as runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import usage as U
from .registry import query

CALLS = "SELECT event_id, ts, user_id, event_type AS route, concat('m', CAST(user_id % 10 AS VARCHAR)) AS model, value AS cost FROM events"
RUNS = "SELECT *, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS ok, CAST(o_orderkey % 4 AS INTEGER) AS attempts, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 5 + 1 AS INTEGER) END AS rating FROM orders"


def calls(read):
    return read("events").select("event_id", "ts", "user_id", F.col("event_type").alias("route"), F.concat(F.lit("m"), (F.col("user_id") % 10).cast("string")).alias("model"), F.col("value").alias("cost"))


def runs(read):
    ok = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    rating = F.when(F.col("o_custkey") % 3 != 0, (F.col("o_custkey") % 5 + 1).cast("int"))
    return read("orders").withColumns({"ok": ok, "attempts": (F.col("o_orderkey") % 4).cast("int"), "rating": rating})


@query(f"""SELECT route, model, count(*) AS calls, sum(CAST(cost AS DECIMAL(18,4))) AS cost, CAST(2 - bit_count(GROUPING_ID(route, model)) AS INTEGER) AS level
FROM ({CALLS}) GROUP BY ROLLUP(route, model)""")
def usage_rollup(read):
    return U.rollup_costs(calls(read), ["route", "model"], "cost").withColumn("cost", F.col("cost").cast("decimal(38,4)"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS calls, CAST(ceil(count(*) * 0.5) AS BIGINT) AS estimate FROM events WHERE ts IS NOT NULL GROUP BY 1")
def usage_daily(read):
    return U.daily(calls(read), "ts")


@query(f"""SELECT route, count(*) AS calls, string_agg(DISTINCT model, '+' ORDER BY model) AS models, min_by(model, event_id) AS first_model, round(sum(CAST(cost AS DECIMAL(18,4))) / count(*), 4) AS mean_cost
FROM ({CALLS}) GROUP BY route""")
def usage_by_route(read):
    return calls(read).groupBy("route").agg(
        F.count("*").alias("calls"), F.array_join(F.array_sort(F.collect_set("model")), "+").alias("models"), F.min_by("model", "event_id").alias("first_model"),
        F.round(F.sum(F.col("cost").cast(U.MONEY)).cast("double") / F.count("*"), 4).alias("mean_cost"),
    )


@query(f"""SELECT count(*) AS runs, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (NOT ok) / count(*), 4) AS failure_rate,
round(sum(CASE WHEN coalesce(attempts, 0) = 0 THEN 0 ELSE attempts - 1 END) / sum(CASE WHEN coalesce(attempts, 0) = 0 THEN 1 ELSE attempts END), 4) AS retry_share,
count(*) >= 5 AND count(*) FILTER (NOT ok) / count(*) >= 0.3 AS alarm
FROM ({RUNS}) WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 720 HOURS""")
def usage_alarm(read):
    return U.alarm(U.trailing(runs(read), "o_orderdate", 720), "ok", "attempts")


@query(f"""SELECT o_orderpriority, count(*) AS runs, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) / count(*), 4) AS success_rate,
count(rating) AS rated, round(avg(rating), 4) AS mean_rating, count(*) FILTER (rating <= 2) AS low_rated FROM ({RUNS}) GROUP BY 1""")
def run_summary(read):
    return U.run_summary(runs(read), ["o_orderpriority"], "ok", "rating")


@query(f"""SELECT route, coalesce(nullif(CASE route WHEN 'click' THEN 'Clicks' WHEN 'view' THEN 'Views' WHEN 'purchase' THEN '' END, ''), nullif(route, ''), 'unknown') AS label, count(*) AS calls FROM ({CALLS}) GROUP BY 1, 2""")
def route_labels(read):
    return U.label_by_dimension(calls(read), {"click": "Clicks", "view": "Views", "purchase": ""}, "route").groupBy("route", "label").agg(F.count("*").alias("calls"))


PRICES = [("STANDARD BRUSHED TIN", 0.02), ("BRASS", 0.03), ("TIN", 0.01), ("COPPER", 0.04)]


@query("""SELECT p_type, CAST(coalesce(CASE WHEN p_type = 'STANDARD BRUSHED TIN' THEN 0.02 END, CASE WHEN contains(lower(p_type), 'standard brushed tin') THEN 0.02 WHEN contains(lower(p_type), 'brass') THEN 0.03 WHEN contains(lower(p_type), 'tin') THEN 0.01 WHEN contains(lower(p_type), 'copper') THEN 0.04 END, 0.005) AS DOUBLE) AS price, count(*) AS parts
FROM part GROUP BY 1, 2""")
def price_lookup(read):
    return read("part").withColumn("price", U.price_of(F.col("p_type"), PRICES, 0.005)).groupBy("p_type", "price").agg(F.count("*").alias("parts"))


@query("SELECT day, event_type, calls, round(calls / max(calls) OVER (PARTITION BY event_type), 4) AS ratio FROM (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS calls FROM events GROUP BY 1, 2)")
def daily_ratio_to_max(read):
    return U.ratio_to_max(read("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("calls")), ["event_type"], "calls")


@query("SELECT coalesce(strftime(ts + INTERVAL 9 HOURS, '%Y-%m-%d'), '0000-00-00') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def local_days(read):
    return read("events").groupBy(U.local_day(F.col("ts")).alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT day, calls FROM (SELECT day, calls, row_number() OVER (ORDER BY day DESC) AS r FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS calls FROM events GROUP BY 1)) WHERE r <= 7""")
def last_days(read):
    return U.daily(calls(read), "ts").select("day", "calls").orderBy(F.desc("day")).limit(7)


@query("""SELECT user_id, event_id, ts FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR ts >= p + INTERVAL 3600 SECONDS""")
def double_fire_guard(read):
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return read("events").withColumn("p", before).where(F.col("p").isNull() | (F.col("ts") >= F.col("p") + F.expr("INTERVAL 3600 SECONDS"))).select("user_id", "event_id", "ts")


@query("""SELECT user_id, session, count(*) AS events, min(ts) AS began, max(ts) AS ended FROM (
SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 12 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY 1, 2""".replace("user_id, session,", "user_id, CAST(session AS BIGINT) AS session,", 1))
def sessions(read):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.lag("ts").over(w)
    marked = read("events").withColumn("new", F.when(new.isNull() | (F.col("ts") > new + F.expr("INTERVAL 12 HOURS")), 1).otherwise(0))
    return marked.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@query("""SELECT event_type, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) // 25 AS INTEGER) AS bucket, count(*) AS n, CAST(median(value) AS DOUBLE) AS middle FROM events GROUP BY 1, 2 HAVING count(*) >= 5""")
def property_medians(read):
    k = F.get_json_object("props", "$.k").cast("int")
    return read("events").groupBy("event_type", F.floor(k / 25).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.median("value").alias("middle")).where("n >= 5")


@query("""SELECT 'event' AS source, event_type AS kind, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'order', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'line', l_returnflag, count(*) FROM lineitem GROUP BY 2""")
def tagged_union(read):
    parts = [("event", "events", "event_type"), ("order", "orders", "o_orderstatus"), ("line", "lineitem", "l_returnflag")]
    one = lambda tag, name, kind: read(name).groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(tag).alias("source"), "kind", "n")
    first, *rest = [one(*p) for p in parts]
    for p in rest:
        first = first.unionByName(p)
    return first


@query("""SELECT segment, max(CASE level WHEN 'ok' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END) AS severity FROM (SELECT c_mktsegment AS segment, CASE WHEN c_acctbal < -900 THEN 'error' WHEN c_acctbal < 0 THEN 'warn' ELSE 'ok' END AS level FROM customer) GROUP BY 1""")
def worst_severity(read):
    level = F.when(F.col("c_acctbal") < -900, 2).when(F.col("c_acctbal") < 0, 1).otherwise(0)
    return read("customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.max(level).alias("severity"))
