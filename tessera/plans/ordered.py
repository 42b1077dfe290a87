"""Queries that SQL does not express: ordered folds, anchored windows, arithmetic, components.  Tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordered as O
from ..operators import retrieval as R
from ..streaming.windows import capped
from .registry import query


ORDERED = "n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber) AS pos, l_linenumber AS num FROM lineitem)"


@query(f"""WITH RECURSIVE {ORDERED}, c AS (SELECT l_orderkey, pos, num, 1 AS length FROM n UNION SELECT n.l_orderkey, n.pos, n.num, c.length + 1 FROM c JOIN n ON n.l_orderkey = c.l_orderkey AND n.pos > c.pos AND n.num >= c.num)
SELECT l_orderkey, max(length) AS length FROM c GROUP BY 1""")
def non_decreasing_lengths(read):
    return non_decreasing_numbers(read).select("l_orderkey", (F.size(F.split("kept", ","))).alias("length"))


@query()
def non_decreasing_numbers(read):
    """The line numbers of an order that form a longest non-decreasing subsequence, in the order of ship dates."""
    rows = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_shipdate", "l_partkey", "l_linenumber"))).alias("s"))
    numbers = rows.select("l_orderkey", F.col("s.l_linenumber").alias("numbers"))
    kept = numbers.withColumn("places", O.non_decreasing("numbers"))
    return kept.select("l_orderkey", F.transform("places", lambda i: F.get(F.col("numbers"), i)).cast("string").alias("kept"))


@query(f"""WITH RECURSIVE {ORDERED}, e AS (SELECT a.l_orderkey, a.pos, min(b.pos) AS nxt FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND b.pos > a.pos AND b.num = a.num + 1 GROUP BY 1, 2),
c AS (SELECT l_orderkey, pos, pos AS at, 1 AS length FROM n UNION ALL SELECT c.l_orderkey, c.pos, e.nxt, c.length + 1 FROM c JOIN e ON e.l_orderkey = c.l_orderkey AND e.pos = c.at)
SELECT l_orderkey, CAST(CASE WHEN max(length) >= 2 THEN max(length) ELSE count(DISTINCT pos) END AS INTEGER) AS length FROM c GROUP BY 1""")
def chains_of_ones(read):
    rows = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_shipdate", "l_partkey", "l_linenumber"))).alias("s"))
    numbers = rows.select("l_orderkey", F.col("s.l_linenumber").alias("numbers"))
    return numbers.select("l_orderkey", F.size(O.chain_of_ones("numbers")).alias("length"))


@query("""WITH RECURSIVE n AS MATERIALIZED (SELECT DISTINCT a.user_id, a.ts, b.ts AS nxt FROM (SELECT DISTINCT user_id, ts FROM events) a ASOF LEFT JOIN (SELECT DISTINCT user_id, ts FROM events) b ON a.user_id = b.user_id AND a.ts + INTERVAL 6 HOUR <= b.ts),
s AS (SELECT user_id, min(ts) AS start FROM events GROUP BY 1 UNION ALL SELECT n.user_id, n.nxt FROM s JOIN n ON n.user_id = s.user_id AND n.ts = s.start WHERE n.nxt IS NOT NULL),
w AS (SELECT e.user_id, e.ts, s.start FROM events e ASOF JOIN s ON e.user_id = s.user_id AND e.ts >= s.start)
SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, start ORDER BY ts) <= 2 AS passed FROM w""")
def anchored_rate_cap(read):
    """Events that pass a cap of 2 in a window of six hours anchored at a user's event."""
    return capped(read("events"), "user_id", "ts", width=6 * 3600.0, most=2)


@query("""SELECT p_partkey, 'E_ARITH_MISMATCH' AS code FROM part WHERE p_partkey % 7 = 0""")
def arithmetic_gate(read):
    text = F.format_string("%d + %d = %d", F.col("p_size"), F.lit(3), F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 4).otherwise(3))
    return read("part").select("p_partkey", F.explode(O.arithmetic_issues(text)).alias("code"))


WORDS = "SELECT doc_id, source, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS t FROM documents"


def alike(rule: str) -> str:
    return f"""WITH RECURSIVE d AS ({WORDS}), p AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.t, y.t)) AS c, len(x.t) AS m, len(y.t) AS n FROM d x JOIN d y ON x.source = y.source AND x.doc_id < y.doc_id) WHERE {rule})"""


@query(alike("c >= 0.85 * (m + n - c)") + """, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT doc_id, doc_id AS component FROM d UNION SELECT e.b, r.component FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, min(component) AS component FROM r GROUP BY 1""")
def near_duplicate_segments(read):
    """Documents of one source whose word sets are similar, grouped."""
    return R.similar_groups(_words(read), "source", "doc_id", "tokens", 0.85)


@query(alike("c >= CASE WHEN least(m, n) >= 200 THEN 0.93 ELSE 0.88 END * (m + n - c) OR c >= 0.85 * least(m, n)") + " SELECT a, b FROM p")
def alike_segments(read):
    """Pairs of one source that are equal, contained one in the other, or similar by a threshold that grows with length."""
    return R.similar_pairs(_words(read), "source", "doc_id", "tokens", 0.88, 200, 0.93, 0.85).select("a", "b")


def _words(read):
    return read("documents").select("doc_id", "source", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("tokens"))
