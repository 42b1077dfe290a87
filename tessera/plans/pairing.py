"""Queries of pairing, integrity and audits over numbered records and file trees.

Line items stand for records: the part as series, the line number as problem number; ship mode flags as sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import records as R
from .registry import query

# a record's problem text is its return flag, its solution the line status; blank where the number is divisible
RECORDS = "SELECT l_orderkey AS doc, l_linenumber AS no, l_partkey AS series, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE l_returnflag END AS content, CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE l_linestatus END AS solution FROM lineitem"


def records(read):
    content = F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.col("l_returnflag"))
    solution = F.when(F.col("l_suppkey") % 3 == 0, " ").otherwise(F.col("l_linestatus"))
    return read("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("series"), content.alias("content"), solution.alias("solution"))


UNPAIRED = "(trim(content) = '') <> (trim(solution) = '')"


@query(f"SELECT doc, no, series FROM ({RECORDS}) WHERE {UNPAIRED}")
def unpaired_records(read):
    """Records that have one side only."""
    return records(read).where((F.trim("content") == "") != (F.trim("solution") == "")).select("doc", "no", "series")


@query(f"""SELECT 'unpaired' AS kind, count(*) AS n FROM ({RECORDS}) WHERE {UNPAIRED} UNION ALL SELECT 'duplicate', count(*) FROM (SELECT 1 FROM ({RECORDS}) GROUP BY series, no HAVING count(*) >= 2)
UNION ALL SELECT 'missing', count(*) FROM (SELECT series FROM (SELECT series, count(DISTINCT no) AS k, max(no) - min(no) + 1 AS w FROM ({RECORDS}) GROUP BY 1) WHERE k >= 3 AND w > k AND (w - k) < 0.5 * w)""")
def integrity_counts(read):
    """Issues by kind: half pairs, numbers that occur twice in a series, series with gaps."""
    rows = records(read)
    half = rows.where((F.trim("content") == "") != (F.trim("solution") == "")).agg(F.lit("unpaired").alias("kind"), F.count("*").alias("n"))
    twice = rows.groupBy("series", "no").agg(F.count("*").alias("c")).where("c >= 2").agg(F.lit("duplicate").alias("kind"), F.count("*").alias("n"))
    spans = rows.groupBy("series").agg(F.countDistinct("no").alias("k"), (F.max("no") - F.min("no") + 1).alias("w"))
    gaps = spans.where("k >= 3 AND w > k AND (w - k) < 0.5 * w").agg(F.lit("missing").alias("kind"), F.count("*").alias("n"))
    return half.union(twice).union(gaps)


BEST = "SELECT doc, no, {0} AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc, no ORDER BY length({0}) DESC, {0}, series) AS r FROM (" + RECORDS + ") WHERE trim({0}) <> '') WHERE r = 1"


@query(f"""SELECT p.doc, p.no, p.t AS problem, s.t AS solution FROM ({BEST.format('content')}) p LEFT JOIN ({BEST.format('solution')}) s ON p.doc = s.doc AND p.no = s.no""")
def paired_within_document(read):
    """Each number's longest problem with its longest solution of the same document; problems without one stay."""
    rows = records(read)
    side = lambda c: R.keep_longest(rows.where(F.trim(c) != ""), ["doc", "no"], c, [c, "series"]).select("doc", "no", F.col(c).alias(c))
    return side("content").withColumnRenamed("content", "problem").join(side("solution"), ["doc", "no"], "left")


PLAN = """SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'problem' WHEN 1 THEN 'solution' WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'problem' ELSE 'solution' END ELSE 'unknown' END AS side,
    CASE WHEN doc_id % 11 <> 0 THEN doc_id // 7 % 5 END AS no, lang AS series, (doc_id % 10) / 10.0 AS confidence, length(text) AS chars, doc_id % 7 = 0 AS filled FROM documents"""
CHOSEN = f"""p AS ({PLAN}), k AS (SELECT * FROM p WHERE confidence >= 0.6 AND no IS NOT NULL AND side <> 'unknown'),
o AS (SELECT *, row_number() OVER (PARTITION BY series, no, side ORDER BY chars DESC, id) AS r, count(*) OVER (PARTITION BY series, no) AS n FROM k),
c AS (SELECT a.series, a.no, a.id AS problem, b.id AS solution, a.filled, a.n FROM o a JOIN o b ON a.series = b.series AND a.no = b.no WHERE a.side = 'problem' AND b.side = 'solution' AND a.r = 1 AND b.r = 1)"""


def _plan(read):
    i = F.col("doc_id")
    side = F.when(i % 4 == 0, "problem").when(i % 4 == 1, "solution").when(i % 4 == 2, F.when(i % 3 == 0, "problem").otherwise("solution")).otherwise("unknown")
    docs = read("documents")
    plan = docs.select(i.alias("id"), side.alias("side"), F.when(i % 11 != 0, F.expr("doc_id div 7 % 5")).alias("no"), F.col("lang").alias("series"), ((i % 10).cast("decimal(2,0)") / 10).alias("confidence"))
    return plan, docs.select(i.alias("id"), F.length("text").alias("chars"), (i % 7 == 0).alias("filled"))


@query(f"WITH {CHOSEN} SELECT series, no, problem, solution FROM c WHERE NOT filled")
def assisted_pairing(read):
    """Of the confident rows of a plan, the longest problem and solution of each series and number, unless it has one."""
    return R.assisted_pairing(*_plan(read)).where("NOT filled").select("series", "no", "problem", "solution")


@query(f"WITH {CHOSEN} SELECT count(*) FILTER (NOT filled) AS updated, CAST((SELECT count(*) FROM p) - coalesce(sum(n), 0) + count(*) FILTER (filled) AS BIGINT) AS skipped FROM c")
def assisted_pairing_counts(read):
    plan, records = _plan(read)
    return R.pairing_counts(plan, R.assisted_pairing(plan, records))


@query("""SELECT p_partkey, coalesce(a.s_acctbal, b.s_acctbal) AS s_acctbal FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS place FROM part) p LEFT JOIN supplier a ON a.s_suppkey = p_partkey AND a.s_suppkey % 3 = 0
LEFT JOIN (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier WHERE s_suppkey % 3 = 0) b ON b.place = p.place""")
def positional_pairs(read):
    """Parts with the balance of the supplier of their number, else of the supplier at their place."""
    suppliers = read("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("p_partkey"), "s_acctbal")
    return R.positional_fallback(read("part").select("p_partkey"), suppliers, "p_partkey", "p_partkey", "s_acctbal")


@query("SELECT event_id, coalesce(ts <> max(ts) OVER (PARTITION BY event_type, user_id), false) AS archived FROM events")
def archived_versions(read):
    """All but the newest of a kind and user's events, which are archived."""
    return R.archived(read("events").select("event_id", "event_type", "user_id", "ts"), ["event_type", "user_id"], "ts").select("event_id", "archived")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P')")
def guarded_semi_join(read):
    """Customers of the list; all of them where the list is empty."""
    listed = read("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.prune(read("customer").select("c_custkey"), listed, "c_custkey")


@query("""SELECT s_nationkey, s_suppkey, s_suppkey = first_value(s_suppkey) OVER w AS keep, n FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE n >= 2 WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)""")
def duplicate_folders(read):
    """Groups of the same name with the one to keep: the fullest, the oldest of equals."""
    groups = W.partitionBy("s_nationkey")
    rows = read("supplier").withColumns({"n": F.count("*").over(groups), "r": F.row_number().over(groups.orderBy(F.desc("s_acctbal"), "s_suppkey"))})
    return rows.where("n >= 2").select("s_nationkey", "s_suppkey", (F.col("r") == 1).alias("keep"), "n")


@query("""SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS extra, count(*) FILTER (best - worst > 5000) AS uneven FROM (SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS best, min(s_acctbal) AS worst FROM supplier GROUP BY 1 HAVING count(*) >= 2)""")
def duplicate_folder_summary(read):
    groups = read("supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_acctbal").alias("best"), F.min("s_acctbal").alias("worst")).where("n >= 2")
    return groups.agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("extra"), F.count_if(F.col("best") - F.col("worst") > 5000).alias("uneven"))


PATHS = "SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS p FROM pages"


def paths(read):
    return read("pages").select("page_id", F.filter(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/"), lambda x: x != "").alias("p"))


@query(f"SELECT CAST(len(p) AS INTEGER) AS depth, count(*) AS n, count(DISTINCT p[1]) AS roots, count(*) FILTER (len(p) < 2) AS shallow, count(*) FILTER (len(p) > 4) AS deep FROM ({PATHS}) GROUP BY 1")
def tree_audit(read):
    """Files by depth, with the roots that they lie in."""
    size = F.size("p")
    return paths(read).groupBy(size.alias("depth")).agg(F.count("*").alias("n"), F.countDistinct(F.get("p", F.lit(0))).alias("roots"), F.count_if(size < 2).alias("shallow"), F.count_if(size > 4).alias("deep"))


@query(f"SELECT array_to_string(p[1:2], ' / ') AS folder, count(*) AS n FROM ({PATHS}) GROUP BY 1")
def by_folder(read):
    return paths(read).groupBy(F.array_join(F.slice("p", 1, 2), " / ").alias("folder")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id, coalesce(p[2], 'misc') AS unit, coalesce(p[3], 'plain') AS type FROM ({PATHS}) WHERE len(p) <= 4 AND NOT list_contains(p, 'archive')")
def path_parts(read):
    """Unit and type by path level, with defaults; deeper paths and skipped folders are left out."""
    rows = paths(read).where((F.size("p") <= 4) & ~F.array_contains("p", "archive"))
    part = lambda i, other: F.coalesce(F.get("p", F.lit(i)), F.lit(other))
    return rows.select("page_id", part(1, "misc").alias("unit"), part(2, "plain").alias("type"))


@query("SELECT count(*) AS checked, count(*) FILTER (length(text) < 40) AS skipped, count(*) FILTER (length(text) >= 40 AND regexp_matches(text, '[#$%&*]{3}')) AS violations FROM documents")
def audit_counters(read):
    long = F.length("text") >= 40
    return read("documents").agg(F.count("*").alias("checked"), F.count_if(~long).alias("skipped"), F.count_if(long & F.col("text").rlike("[#$%&*]{3}")).alias("violations"))


@query("SELECT conv_id, list(turn ORDER BY turn) FILTER (length(text) < 60)::VARCHAR AS failed, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS size FROM conversations GROUP BY 1")
def failed_pages(read):
    """Pages of a book whose text is too short, from the statuses of all its pages."""
    status = F.array_sort(F.collect_list(F.struct("turn", (F.length("text") >= 60).alias("ok"))))
    failed = F.transform(F.filter(status, lambda s: ~s["ok"]), lambda s: s["turn"])
    shown = F.when(F.size(failed) > 0, F.concat(F.lit("["), F.array_join(failed.cast("array<string>"), ", "), F.lit("]")))
    return read("conversations").groupBy("conv_id").agg(shown.alias("failed"), F.count("*").alias("pages"), F.sum(F.length("text")).alias("size"))


@query("SELECT o_custkey, CASE WHEN length(s) > 220 THEN array_to_string(parts[1:10], ' ') || ' …' ELSE s END AS answers FROM (SELECT o_custkey, list(o_orderkey || ':' || o_orderstatus ORDER BY o_orderkey) AS parts, string_agg(o_orderkey || ':' || o_orderstatus, ' ' ORDER BY o_orderkey) AS s FROM orders GROUP BY 1)")
def quick_answers(read):
    """The answers of a set in one line, cut to ten where it is long."""
    part = F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus")
    rows = read("orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("t")))), lambda x: x["t"]).alias("parts"))
    whole = F.array_join("parts", " ")
    return rows.select("o_custkey", F.when(F.length(whole) > 220, F.concat(F.array_join(F.slice("parts", 1, 10), " "), F.lit(" …"))).otherwise(whole).alias("answers"))


TAGS = "string_split(lower(p_type), ' ')"


@query(f"""WITH q AS (SELECT p_partkey AS q, {TAGS} AS a FROM part WHERE p_partkey % 500 = 1), best AS (SELECT q, p_partkey, row_number() OVER (PARTITION BY q ORDER BY score DESC, p_partkey) AS rank, score FROM (SELECT q, p_partkey,
CASE WHEN a[1] = b[1] THEN 4 WHEN contains(a[1], b[1]) OR contains(b[1], a[1]) THEN 2 ELSE 0 END + CASE WHEN a[2] = b[2] THEN 3 WHEN contains(a[2], b[2]) OR contains(b[2], a[2]) THEN 1 ELSE 0 END + CASE WHEN a[3] = b[3] THEN 2 WHEN contains(a[3], b[3]) OR contains(b[3], a[3]) THEN 1 ELSE 0 END AS score
FROM q, (SELECT p_partkey, {TAGS} AS b FROM part))) SELECT q, p_partkey, CAST(rank AS INTEGER) AS rank, score FROM best WHERE rank <= 12 AND score > 0""")
def tag_similarity(read):
    """The twelve rows whose three tags are most like a query's; those without any likeness go after the cut.

    Distinct tags are few: they are scored once and the parts joined to them afterwards.
    """
    tags = read("part").select("p_partkey", F.split(F.lower("p_type"), " ").alias("t"))
    asked = tags.where("p_partkey % 500 = 1").select(F.col("p_partkey").alias("q"), F.col("t").alias("a"))
    kinds, wanted = tags.select(F.col("t").alias("b")).distinct(), asked.select("a").distinct()
    like = lambda i, same, part: F.when(F.get("a", F.lit(i)) == F.get("b", F.lit(i)), same).when(F.contains(F.get("a", F.lit(i)), F.get("b", F.lit(i))) | F.contains(F.get("b", F.lit(i)), F.get("a", F.lit(i))), part).otherwise(0)
    scored = wanted.join(F.broadcast(kinds), F.lit(True)).withColumn("score", like(0, 4, 2) + like(1, 3, 1) + like(2, 2, 1))  # a stated query set against the kinds of tags
    firsts = tags.withColumn("n", F.row_number().over(W.partitionBy("t").orderBy("p_partkey"))).where("n <= 12")  # of a kind no more than twelve can be among twelve
    found = asked.join(scored, "a").join(firsts.select(F.col("t").alias("b"), "p_partkey"), "b")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "p_partkey"))
    return found.withColumn("rank", rank).where("rank <= 12").where("score > 0").select("q", "p_partkey", "rank", "score")


@query("""SELECT prefix, doc_id FROM (SELECT substr(regexp_replace(trim(text), '\\s+', ' ', 'g'), 1, 60) AS prefix, doc_id, row_number() OVER (PARTITION BY substr(regexp_replace(trim(text), '\\s+', ' ', 'g'), 1, 60) ORDER BY doc_id DESC) AS r
FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND len(list_filter(['die', 'the'], lambda t: contains(lower(text), t))) > 0) WHERE r = 1 ORDER BY doc_id DESC LIMIT 7""")
def caution_lookup(read):
    """The latest badly rated texts that hold one of the words, one of each beginning."""
    words = F.array(F.lit("die"), F.lit("the"))
    bad = read("labels").where("quality = 0").select("doc_id")
    rows = read("documents").join(bad, "doc_id").where(F.exists(words, lambda t: F.contains(F.lower("text"), t)))
    prefix = F.substring(F.regexp_replace(F.trim("text"), r"\s+", " "), 1, 60)
    return rows.groupBy(prefix.alias("prefix")).agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("doc_id")).limit(7)


# What is suggested for which counts, first match of an area counts
RECORD_RULES = {
    "format": [("high", "exam_name >= 5")],
    "json": [("medium", "json >= 3")],
    "header": [("medium", "header >= 3")],
    "pairing_rate": [("high", "problems >= 20 AND paired < 0.4 * problems"), ("medium", "problems >= 20 AND paired < 0.7 * problems")],
    "missing": [("high", "missing >= 10"), ("medium", "missing > 0")],
    "duplicate": [("medium", "duplicate >= 5"), ("low", "duplicate > 0")],
    "unpaired": [("high", "unpaired >= 5")],
    "records": [("high", "records = 0"), ("low", "records < 50")],
}


def _priority(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {rule} THEN '{p}'" for p, rule in rules) + " END"


COUNTED = f"""p AS ({PLAN}), g AS (SELECT series, no, count(*) FILTER (side = 'problem') AS a, count(*) FILTER (side = 'solution') AS b FROM p WHERE no IS NOT NULL GROUP BY 1, 2),
one AS (SELECT (SELECT count(*) FROM events WHERE event_type = 'error' AND event_id % 3 = 0) AS exam_name, (SELECT count(*) FROM events WHERE event_type = 'error' AND event_id % 3 = 1 AND event_id < 100) AS json, (SELECT count(*) FROM events WHERE event_type = 'none') AS header,
    (SELECT count(*) FROM p WHERE side = 'problem' AND no IS NOT NULL) AS problems, (SELECT count(*) FROM p WHERE side = 'problem' AND no IS NOT NULL AND filled) AS paired,
    (SELECT coalesce(sum(high - low + 1 - n), 0) FROM (SELECT series, max(no) AS high, min(no) AS low, count(DISTINCT no) AS n FROM g GROUP BY 1)) AS missing,
    (SELECT count(*) FROM g WHERE a >= 2 OR b >= 2) AS duplicate, (SELECT count(*) FROM g WHERE (a = 0) <> (b = 0)) AS unpaired, (SELECT count(*) FROM documents) AS records)"""


@query(f"WITH {COUNTED} SELECT area, priority FROM (" + " UNION ALL ".join(f"SELECT '{area}' AS area, {_priority(rules)} AS priority FROM one" for area, rules in RECORD_RULES.items()) + ") WHERE priority IS NOT NULL")
def record_suggestions(read):
    """What the counts of records, of their gaps, duplicates and pairs, and of bad formats suggest."""
    plan, filled = _plan(read)
    error = read("events").where("event_type IN ('error', 'none')")
    formats = error.agg(F.count_if(F.expr("event_type = 'error' AND event_id % 3 = 0")).alias("exam_name"), F.count_if(F.expr("event_type = 'error' AND event_id % 3 = 1 AND event_id < 100")).alias("json"), F.count_if(F.expr("event_type = 'none'")).alias("header"))
    rows = plan.join(filled, "id")
    is_problem = (F.col("side") == "problem") & F.col("no").isNotNull()
    sizes = rows.agg(F.count_if(is_problem).alias("problems"), F.count_if(is_problem & F.col("filled")).alias("paired"), F.count("*").alias("records"))
    groups = plan.where("no IS NOT NULL").groupBy("series", "no").agg(F.count_if(F.col("side") == "problem").alias("a"), F.count_if(F.col("side") == "solution").alias("b"))
    by_series = groups.groupBy("series").agg((F.max("no") - F.min("no") + 1 - F.count("*")).alias("gap"), F.count_if(F.expr("a >= 2 OR b >= 2")).alias("d"), F.count_if(F.expr("(a = 0) <> (b = 0)")).alias("u"))
    integrity = by_series.agg(F.coalesce(F.sum("gap"), F.lit(0)).alias("missing"), F.coalesce(F.sum("d"), F.lit(0)).alias("duplicate"), F.coalesce(F.sum("u"), F.lit(0)).alias("unpaired"))
    one = formats.crossJoin(sizes).crossJoin(integrity)  # a row each
    found = F.array(*[F.struct(F.lit(area).alias("area"), F.expr(_priority(rules)).alias("priority")) for area, rules in RECORD_RULES.items()])
    return one.select(F.inline(found)).where("priority IS NOT NULL")
