"""Queries of usage and run analysis with the thresholds of their rules: diagnoses, suggestions, sliding alarms, filters.

Events stand for calls (event_type as route, the user's last digit as model), orders for runs (see usage.py).
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import usage as U
from .registry import query
from .usage import CALLS, RUNS, calls, runs

#: Price of a call by the last digit of the model, the others cost the default.
PRICES = [("m1", 0.02), ("m2", 0.005), ("m3", 0.4)]
PRICE_SQL = "CASE model " + " ".join(f"WHEN '{k}' THEN {p}" for k, p in PRICES) + " ELSE 0.005 END"


@query(f"""SELECT model, count(*) AS calls, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(CAST({PRICE_SQL} AS DECIMAL(10,6)) * n) AS DECIMAL(28,6)) AS usd FROM
(SELECT model, CAST(user_id % 3 + 1 AS BIGINT) AS n FROM ({CALLS}) WHERE NOT starts_with(route, 'err')) GROUP BY 1""")
def cost_by_model(read):
    """Calls, attempts and cost by model; routes of an excluded prefix are counted elsewhere."""
    rows = calls(read).where(~F.col("route").startswith("err")).withColumn("n", F.col("user_id") % 3 + 1)
    price = U.price_of(F.col("model"), PRICES, 0.005).cast("decimal(10,6)")
    return rows.groupBy("model").agg(F.count("*").alias("calls"), F.sum("n").alias("attempts"), F.sum(price * F.col("n")).cast("decimal(28,6)").alias("usd"))


#: Fixed price of a row, by category.
CATEGORY = {"purchase": 3, "view": 1}


@query("SELECT event_type, count(*) AS n, CAST(count(*) * CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 1 ELSE 0 END AS BIGINT) AS price FROM events GROUP BY 1")
def category_fixed_price(read):
    price = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in CATEGORY.items()], F.lit(0))
    return read("events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", "n", (F.col("n") * price).alias("price"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1")
def last_hour_by_route(read):
    return U.trailing(read("events"), "ts", 1).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT start, n, failed, n >= 5 AND failed > 0.3 * n AS alarm FROM (SELECT start, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM
(SELECT event_type, unnest(list_transform(range(24), lambda i: date_trunc('hour', ts) - CAST(i AS INTEGER) * INTERVAL 1 HOUR)) AS start FROM events) GROUP BY 1)""")
def sliding_alarm(read):
    """Failures in every window of 24 hours that starts at a full hour."""
    windows = read("events").groupBy(F.window("ts", "24 hours", "1 hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return windows.select(F.col("window.start").alias("start"), "n", "failed", ((F.col("n") >= 5) & (F.col("failed") > 0.3 * F.col("n"))).alias("alarm"))


DAYS = "(SELECT count(DISTINCT CAST(ts AS DATE)) FROM events)"
TOTALS = f"""SELECT (SELECT count(*) FROM runs) AS runs, (SELECT count(*) FROM runs WHERE ok = false) AS failed, (SELECT CAST(sum(a - 1) AS DOUBLE) / sum(a) FROM runs) AS retries, (SELECT CAST(sum(a) AS DOUBLE) / count(*) FROM runs) AS mean_attempts,
(SELECT count(*) FROM events) / {DAYS} AS a_day, (SELECT CAST(count(*) FILTER (user_id % 10 = 3) AS DOUBLE) / count(*) FROM events) AS heavy, (SELECT count(*) FROM documents) / {DAYS} AS records_a_day"""
#: Level and condition of a diagnosis over the totals of runs, events and documents.
DIAGNOSES = {
    "failure_rate": ("high", "runs >= 5 AND failed > 0.30 * runs"),
    "retry_share": ("warn", "runs >= 5 AND retries > 0.70"),
    "many_calls": ("high", "a_day > 30"),
    "repeated_calls": ("warn", "mean_attempts > 1.5"),
    "heavy_model": ("warn", "heavy > 0.5"),
    "many_records": ("warn", "records_a_day > 100"),
    "no_calls": ("info", "runs = 0 AND a_day = 0"),
}
ATTEMPTED = f"WITH runs AS (SELECT ok, CASE WHEN coalesce(attempts, 0) = 0 THEN 1 ELSE attempts END AS a FROM ({RUNS}))"


@query(f"{ATTEMPTED}, totals AS ({TOTALS}) " + " UNION ALL ".join(f"SELECT '{n}' AS diagnosis, '{level}' AS level FROM totals WHERE {rule}" for n, (level, rule) in DIAGNOSES.items()))
def cost_diagnoses(read):
    a = F.when(F.coalesce("attempts", F.lit(0)) == 0, 1).otherwise(F.col("attempts"))
    of_runs = runs(read).agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("failed"), (F.sum(a - 1) / F.sum(a)).alias("retries"), (F.sum(a) / F.count("*")).alias("mean_attempts"))
    days = F.countDistinct(F.to_date("ts"))
    of_events = read("events").agg((F.count("*") / days).alias("a_day"), (F.count_if(F.col("user_id") % 10 == 3) / F.count("*")).alias("heavy"), days.alias("days"))
    totals = of_runs.crossJoin(F.broadcast(of_events)).crossJoin(F.broadcast(read("documents").agg(F.count("*").alias("docs"))))  # one row each
    totals = totals.withColumn("records_a_day", F.col("docs") / F.col("days"))
    found = F.array_compact(F.array(*[F.when(F.expr(rule), F.struct(F.lit(n).alias("diagnosis"), F.lit(level).alias("level"))) for n, (level, rule) in DIAGNOSES.items()]))
    return totals.select(F.inline(found))


SUMMARY = f"SELECT count(*) AS runs, count(*) FILTER (ok) AS good, count(rating) AS reviewed, count(*) FILTER (rating <= 2) AS low FROM ({RUNS})"
#: Priority and condition of a suggestion over the summary of runs.
SUGGESTIONS = {
    "success_rate_low": ("high", "runs >= 10 AND good < 0.7 * runs"),
    "success_rate_fair": ("medium", "runs >= 10 AND good >= 0.7 * runs AND good < 0.9 * runs"),
    "low_ratings": ("high", "low >= 3"),
    "few_reviews": ("low", "runs >= 20 AND reviewed < 0.1 * runs"),
    "no_records": ("high", "runs = 0"),
    "few_records": ("low", "runs > 0 AND runs < 50"),
}


@query(f"WITH s AS ({SUMMARY}), " + f"""m AS (SELECT max(r) - min(r) AS spread, count(*) AS models FROM (SELECT CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) AS r FROM ({RUNS}) GROUP BY o_orderpriority HAVING count(*) >= 5)) """
       + " UNION ALL ".join(f"SELECT '{n}' AS area, '{p}' AS priority FROM s WHERE {rule}" for n, (p, rule) in SUGGESTIONS.items()) + " UNION ALL SELECT 'model_order', 'medium' FROM m WHERE models >= 2 AND spread > 0.2")
def suggestions(read):
    rows = runs(read)
    summary = rows.agg(F.count("*").alias("runs"), F.count_if("ok").alias("good"), F.count("rating").alias("reviewed"), F.count_if(F.col("rating") <= 2).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.expr(rule), F.struct(F.lit(n).alias("area"), F.lit(p).alias("priority"))) for n, (p, rule) in SUGGESTIONS.items()]))
    by_model = rows.groupBy("o_orderpriority").agg((F.count_if("ok") / F.count("*")).alias("r"), F.count("*").alias("n")).where("n >= 5")
    spread = by_model.agg((F.max("r") - F.min("r")).alias("spread"), F.count("*").alias("models")).where("models >= 2 AND spread > 0.2")
    return summary.select(F.inline(found)).union(spread.select(F.lit("model_order"), F.lit("medium")))


#: Filter modes of a list of runs.
MODES = {"all": "true", "ok": "ok", "fail": "ok = false", "unreviewed": "rating IS NULL", "low-rated": "rating <= 2"}


@query(" UNION ALL ".join(f"SELECT '{m}' AS mode, count(*) AS n FROM ({RUNS}) WHERE ({c}) AND contains(lower(concat_ws(' ', o_orderpriority, o_orderstatus)), 'o')" for m, c in MODES.items()))
def filter_modes(read):
    """Runs by filter mode that hold the searched text in one of their columns."""
    rows = runs(read).where(F.contains(F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")), F.lit("o")))
    counts = rows.agg(*[F.count_if(F.expr(c)).alias(m) for m, c in MODES.items()])
    return counts.unpivot([], list(MODES), "mode", "n")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY - INTERVAL 5 SECOND AND (CAST(NULL AS VARCHAR) IS NULL OR o_orderpriority = NULL)""")
def resumed_runs(read):
    """Runs since a start less five seconds, of one priority if one is given."""
    last = read("orders").agg(F.max("o_orderdate").alias("_last"))
    return read("orders").crossJoin(F.broadcast(last)).where("o_orderdate >= _last - INTERVAL 30 DAY - INTERVAL 5 SECOND").select("o_orderkey")


@query("""SELECT page_id, CASE WHEN url IS NULL OR strlen(url) < 3 THEN 'no_url' WHEN html IS NULL THEN 'kept' WHEN strlen(html) > 20000 THEN 'too_large' WHEN length(html) >= 200 THEN 'kept' ELSE 'too_small' END AS gate FROM pages""")
def size_gate(read):
    """Pages by size limits; a page of unknown size passes."""
    gate = F.when(F.col("url").isNull() | (F.octet_length("url") < 3), "no_url").when(F.col("html").isNull(), "kept").when(F.octet_length("html") > 20000, "too_large").when(F.length("html") >= 200, "kept").otherwise("too_small")
    return read("pages").select("page_id", gate.alias("gate"))


@query("SELECT doc_id FROM documents WHERE len(list_filter(['trash', 'license', 'und'], lambda t: contains(lower(text), t))) > 0")
def any_token(read):
    """Documents that hold one of the searched words, once the signs of patterns are blanked out of them."""
    words = F.filter(F.split(F.translate(F.lit("trash%,license_und"), "%_,", "   "), " +"), lambda t: t != "")
    return read("documents").where(F.exists(words, lambda t: F.contains(F.lower("text"), t))).select("doc_id")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderkey LIMIT 10")
def selected_with_cap(read):
    return read("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).orderBy("o_orderkey").limit(10).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, CAST(greatest(5, least(30, floor(coalesce(TRY_CAST(regexp_extract(p_type, '[0-9]+') AS DOUBLE), p_size)))) AS BIGINT) AS days FROM part")
def clamped_parameter(read):
    given = F.coalesce(F.regexp_extract("p_type", "[0-9]+", 0).try_cast("double"), F.col("p_size").cast("double"))
    return read("part").select("p_partkey", F.greatest(F.lit(5), F.least(F.lit(30), F.floor(given))).alias("days"))


@query("""SELECT CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey IN (3, 5)) THEN 'ids' ELSE 'all' END AS by, s_suppkey FROM supplier WHERE s_suppkey IN (3, 5)""")
def target_precedence(read):
    """Chosen keys, else names that hold a text, else all."""
    rows = read("supplier")
    level = F.when(F.col("s_suppkey").isin(3, 5), 0).when(F.contains("s_name", F.lit("00001")), 1).otherwise(2)
    marked = rows.withColumn("level", level)
    best = marked.agg(F.min("level").alias("best"))
    by = F.element_at(F.array(F.lit("ids"), F.lit("name"), F.lit("all")), F.col("level") + 1)
    return marked.join(F.broadcast(best), F.col("level") == F.col("best")).select(by.alias("by"), "s_suppkey")


@query("""SELECT o_orderstatus, o_orderkey, CAST(r AS INTEGER) AS r FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 999 END, o_orderdate DESC, o_orderkey) AS r FROM (SELECT * FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 999 END, o_orderdate DESC, o_orderkey LIMIT 50))""")
def listed_by_status(read):
    """The first fifty by a list of statuses, then the newest; unknown statuses last."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(999)
    order = [rank, F.desc("o_orderdate"), "o_orderkey"]
    top = read("orders").orderBy(*order).limit(50)
    return top.withColumn("r", F.row_number().over(W.orderBy(*order))).select("o_orderstatus", "o_orderkey", "r")  # fifty rows


@query("""SELECT p_partkey, CAST(r AS INTEGER) AS r FROM (SELECT p_partkey, row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_extract(p_name, '^[0-9]+') AS INTEGER), 0), p_name DESC, p_partkey) AS r FROM part) WHERE r <= 25""")
def numeric_then_name(read):
    order = [F.coalesce(F.regexp_extract("p_name", "^[0-9]+", 0).try_cast("int"), F.lit(0)), F.desc("p_name"), F.col("p_partkey")]
    return read("part").orderBy(*order).limit(25).withColumn("r", F.row_number().over(W.orderBy(*order))).select("p_partkey", "r")


@query("SELECT c_custkey, CAST(r AS INTEGER) AS r FROM (SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END, c_acctbal, c_custkey) AS r FROM customer) WHERE r <= 40")
def sentinel_last(read):
    order = [F.when(F.col("c_acctbal") < 0, 1).otherwise(0), F.col("c_acctbal"), F.col("c_custkey")]
    return read("customer").orderBy(*order).limit(40).withColumn("r", F.row_number().over(W.orderBy(*order))).select("c_custkey", "r")


@query("""SELECT o_orderpriority AS model, count(*) AS runs, round(count(*) FILTER (ok) / count(*), 4) AS success_rate, round(CAST(sum(coalesce(attempts, 0)) AS DOUBLE) / count(*), 4) AS mean_attempts FROM (SELECT coalesce(nullif(o_orderpriority, ''), 'unknown') AS o_orderpriority, ok, attempts FROM (""" + RUNS + ")) GROUP BY 1")
def model_performance(read):
    model = F.coalesce(F.nullif("o_orderpriority", F.lit("")), F.lit("unknown"))
    return runs(read).groupBy(model.alias("model")).agg(F.count("*").alias("runs"), F.round(F.count_if("ok") / F.count("*"), 4).alias("success_rate"), F.round(F.sum(F.coalesce("attempts", F.lit(0))) / F.count("*"), 4).alias("mean_attempts"))


@query("SELECT CAST(o_orderdate + INTERVAL 9 HOUR AS DATE) AS day, o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS good, strftime(max(o_orderdate) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS newest FROM orders GROUP BY 1, 2")
def local_groups(read):
    """Runs by local day and priority, with the label of the newest."""
    local = F.col("o_orderdate") + F.expr("INTERVAL 9 HOURS")
    return read("orders").groupBy(F.to_date(local).alias("day"), "o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("good"), F.date_format(F.max(local), "yyyy-MM-dd HH:mm").alias("newest"))


@query("SELECT o_orderpriority, printf('%.1f%%', round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1)) AS share, CAST(floor(count(*) * 0.0031 * 1330 + 0.5) AS BIGINT) AS won FROM orders GROUP BY 1")
def formatted_shares(read):
    share = F.format_string("%.1f%%", F.round(100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 1))
    return read("orders").groupBy("o_orderpriority").agg(share.alias("share"), F.floor(F.count("*") * 0.0031 * 1330 + 0.5).alias("won"))
