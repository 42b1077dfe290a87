"""Reports as Markdown, blocks of examples for prompts, chains of priority, and gates of chained equations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import ordered as O
from ..functions import review as R
from ..functions import text as T
from ..operators.joins import by_document
from ..operators.positions import checkpointed
from .indexed import indexed_top_k
from .records import snapshot_diff
from .registry import ORACLE_SQL, query


def markdown_table(rows: DataFrame, by: list[str], columns: list[str], order: str) -> DataFrame:
    """(by, report): rows of each group as a Markdown table in their order; groups are reports, so they are small."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return rows.groupBy(*by).agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("report"))


@query("""SELECT event_type, '| day | calls | users | mean |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || day || ' | ' || calls || ' | ' || users || ' | ' || printf('%.2f', mean) || ' |', chr(10) ORDER BY day) AS report FROM
(SELECT coalesce(event_type, '-') AS event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, count(DISTINCT user_id) AS users, CAST(round(sum(CAST(floor(value) AS BIGINT)) / count(value), 2) AS DOUBLE) AS mean FROM events WHERE ts IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def daily_reports(read):
    """A report of each kind of event by day: calls, users and the mean of whole values."""
    mean = F.round(F.sum(F.floor("value").cast("long")) / F.count("value"), 2)
    days = read("events").where("ts IS NOT NULL").groupBy(F.coalesce("event_type", F.lit("-")).alias("event_type"), F.to_date("ts").cast("string").alias("day"))
    days = days.agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), F.format_string("%.2f", mean).alias("mean"))
    return markdown_table(days, ["event_type"], ["day", "calls", "users", "mean"], "day")


@query(f"""SELECT '# Changes' || chr(10) || string_agg('## ' || state || ' (' || n || ')' || chr(10) || first, chr(10) ORDER BY state) AS report FROM
(SELECT state, count(*) AS n, array_to_string(list_transform(list(custkey ORDER BY custkey)[1:5], lambda x: '- ' || x), chr(10)) AS first FROM ({ORACLE_SQL['snapshot_diff']}) GROUP BY 1)""")
def snapshot_report(read):
    """The differences of two snapshots as a report: of each state its number and its first keys."""
    rows = snapshot_diff(read)
    rank = F.row_number().over(W.partitionBy("state").orderBy("custkey"))
    first = rows.withColumn("r", rank).where("r <= 5").groupBy("state").agg(F.array_join(F.transform(F.array_sort(F.collect_list("custkey")), lambda k: F.concat(F.lit("- "), k.cast("string"))), "\n").alias("first"))
    sections = rows.groupBy("state").agg(F.count("*").alias("n")).join(first, "state")
    text = F.concat(F.lit("## "), "state", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), "first")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("state", text.alias("t")))), lambda x: x["t"])
    return sections.agg(F.concat(F.lit("# Changes\n"), F.array_join(ordered, "\n")).alias("report"))



@query(f"SELECT page_id, split_part(regexp_replace(url, '^https?://[^/?#]+/?|[?#].*$', '', 'g'), '/', 1) AS root FROM pages WHERE split_part(regexp_replace(url, '^https?://[^/?#]+/?|[?#].*$', '', 'g'), '/', 1) IN ('en', 'de')")
def allowed_roots(read):
    """Pages whose first folder is allowed."""
    root = F.split(F.regexp_replace("url", r"^https?://[^/?#]+/?|[?#].*$", ""), "/")[0]
    return read("pages").select("page_id", root.alias("root")).where(F.col("root").isin("en", "de"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS place FROM orders) QUALIFY place = min(place) OVER (PARTITION BY o_custkey)""")
def prioritised_orders(read):
    """Each customer's orders of the first status that has any: pending, then filled, then open ones."""
    place = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    rows = read("orders").select("o_custkey", "o_orderkey", place.alias("place"))
    first = rows.groupBy("o_custkey").agg(F.min("place").alias("place"))  # pre-aggregated, so a busy customer is one row
    return rows.join(first, ["o_custkey", "place"]).select("o_custkey", "o_orderkey")


@query("""SELECT count(*) AS scanned, count(*) FILTER (already) AS already, count(*) FILTER (NOT already AND no BETWEEN 1 AND 99) AS extracted, array_to_string(list(p_partkey ORDER BY p_partkey) FILTER (NOT already AND no BETWEEN 1 AND 99)[1:30], ',') AS samples
FROM (SELECT p_partkey, p_size % 4 = 0 AS already, p_partkey % 120 AS no FROM part)""")
def backfill_counters(read):
    """Rows scanned, rows that have a number already, rows that one can be taken from, and the first of these."""
    text = F.concat(F.lit("[문항 "), (F.col("p_partkey") % 120).cast("string"), F.lit("] "), F.translate("p_name", "0123456789.)번", ""))
    rows = read("part").select("p_partkey", (F.col("p_size") % 4 == 0).alias("already"), T.problem_number(text).alias("no"))
    taken = ~F.col("already") & F.col("no").isNotNull()
    first = rows.where(taken).orderBy("p_partkey").limit(30).agg(F.array_join(F.array_sort(F.collect_list("p_partkey")).cast("array<string>"), ",").alias("samples"))
    counts = rows.agg(F.count("*").alias("scanned"), F.count_if("already").alias("already"), F.count_if(taken).alias("extracted"))
    return counts.crossJoin(F.broadcast(first))


STYLE, SUFFIX = 60, "… (cut)"
BLOCK = "'<예시 ' || rank || '>' || chr(10) || '[문제] ' || problem || chr(10) || '[해설]' || chr(10) || {} || chr(10) || '</예시 ' || rank || '>'"
CUT = f"CASE WHEN length(solution) <= {STYLE} THEN solution ELSE regexp_replace(substr(solution, 1, {STYLE}), '[ \\t\\n\\r]+\\z', '') || '{SUFFIX}' END"


@query(f"""SELECT item_id, string_agg({BLOCK.format('solution')}, chr(10) || chr(10) ORDER BY rank) AS whole, string_agg({BLOCK.format(CUT)}, chr(10) || chr(10) ORDER BY rank) AS styled FROM
(SELECT item_id, rank, replace(replace(substr(text, 1, 80), chr(1), ''), chr(2), '') AS problem, replace(replace(substr(text, 81, 200), chr(1), ''), chr(2), '') AS solution FROM ({ORACLE_SQL['indexed_top_k']}) JOIN documents USING (doc_id)) GROUP BY 1""")
def example_blocks(read):
    """The documents found for each benchmark item as blocks of examples, whole and cut to their style."""
    docs = read("documents").select("doc_id", *[F.translate(F.substring("text", a, n), "\u0001\u0002", "").alias(c) for c, a, n in (("problem", 1, 80), ("solution", 81, 200))])
    found = docs.join(by_document(checkpointed(indexed_top_k(read))), "doc_id")
    block = lambda body: F.concat(F.lit("<예시 "), F.col("rank").cast("string"), F.lit(">\n[문제] "), "problem", F.lit("\n[해설]\n"), body, F.lit("\n</예시 "), F.col("rank").cast("string"), F.lit(">"))
    blocks = found.select("item_id", F.struct("rank", block(F.col("solution")).alias("whole"), block(R.styled(F.col("solution"), STYLE, SUFFIX)).alias("styled")).alias("b"))
    held = blocks.groupBy("item_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return held.select("item_id", *[F.array_join(F.col(f"b.{c}"), "\n\n").alias(c) for c in ("whole", "styled")])


@query("""SELECT l_orderkey, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN 'E_CHAIN_EQ_MISMATCH' WHEN 1 THEN 'E_INEQ_CHAIN_MISMATCH' ELSE 'E_ARITH_MISMATCH' END AS code FROM lineitem
WHERE CASE WHEN l_partkey % 3 = 1 THEN NOT (l_linenumber < CAST(l_quantity AS BIGINT) AND CAST(l_quantity AS BIGINT) < l_suppkey) ELSE l_suppkey % 5 = 0 END""")
def chain_gate(read):
    """Chains of equations and inequalities that do not hold, from the numbers of line items."""
    a, q, s = F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long"), F.col("l_suppkey")
    off = a + q + F.when(s % 5 == 0, 1).otherwise(0)
    text = F.when(F.col("l_partkey") % 3 == 0, F.format_string("%d + %d = %d = %d", a, q, a + q, off)).when(F.col("l_partkey") % 3 == 1, F.format_string("%d < %d < %d", a, q, s)).otherwise(F.format_string("%d + %d = %d", a, q, off))
    return read("lineitem").select("l_orderkey", "l_linenumber", F.explode(O.arithmetic_issues(text)).alias("code"))


@query("SELECT doc_id, sha1(concat_ws(' ', substr(text, 1, 40), coalesce(source, ''), CASE WHEN n_chars % 2 = 0 THEN substr(text, 41, 100) END)) AS digest FROM documents")
def index_texts(read):
    """What is indexed of a record: its hint, its content and its solution, where it has one."""
    solution = F.when(F.col("n_chars") % 2 == 0, F.substring("text", 41, 100))
    return read("documents").select("doc_id", F.sha1(F.concat_ws(" ", F.substring("text", 1, 40), F.coalesce("source", F.lit("")), solution)).alias("digest"))


DEPTH = "len(list_filter(string_split(regexp_replace(url, '^https?://[^/?#]+|[?#].*$', '', 'g'), '/'), lambda x: x <> ''))"


@query(f"""SELECT depth, ext, count(*) AS n, array_to_string(list(page_id ORDER BY page_id)[1:3], ',') AS samples FROM
(SELECT page_id, CAST({DEPTH} AS INTEGER) AS depth, coalesce(nullif(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]\\.([A-Za-z0-9]+)$', 1)), ''), '(none)') AS ext FROM pages) GROUP BY 1, 2""")
def tree_extensions(read):
    """Pages by depth and extension, with the first three of each."""
    path = F.regexp_replace("url", r"[?#].*$", "")
    folders = F.filter(F.split(F.regexp_replace(path, r"^https?://[^/?#]+", ""), "/"), lambda x: x != "")
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1)), F.lit("")), F.lit("(none)"))
    rows = read("pages").select("page_id", F.size(folders).alias("depth"), ext.alias("ext"))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("depth", "ext").orderBy("page_id"))).where("r <= 3")
    samples = first.groupBy("depth", "ext").agg(F.array_join(F.array_sort(F.collect_list("page_id")).cast("array<string>"), ",").alias("samples"))
    return rows.groupBy("depth", "ext").agg(F.count("*").alias("n")).join(samples, ["depth", "ext"])
