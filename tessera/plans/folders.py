"""Queries over folders, logs of runs and boxes of pages.

Customers stand for folders, grouped by nation and segment; line items for the pieces of a page; events for calls.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .inline import carried, carry, some_after
from .registry import query

FOLDERS = """SELECT c_nationkey AS nation, c_mktsegment AS segment, c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 7 ELSE 0 END AS files,
    c_custkey % 11 = 0 AS manifest, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey * 37) % 1000 END AS created FROM customer"""


@query(f"""WITH f AS ({FOLDERS}), g AS (SELECT *, sum(CASE WHEN files > 0 THEN 1 ELSE 0 END) OVER w AS filled, sum(CASE WHEN manifest THEN 1 ELSE 0 END) OVER w AS manifests,
    sum(CASE WHEN files > 0 AND NOT manifest THEN 1 ELSE 0 END) OVER w AS others, row_number() OVER (PARTITION BY nation, segment ORDER BY files DESC, created NULLS LAST, id) AS place
    FROM f WINDOW w AS (PARTITION BY nation, segment)),
    v AS (SELECT *, CASE WHEN manifests >= 2 THEN 'stale' WHEN manifests = 1 AND others = 0 THEN 'manifest' WHEN manifests = 1 OR filled >= 2 THEN 'manual' ELSE 'files' END AS verdict FROM g)
    SELECT nation, segment, id, CASE WHEN verdict = 'manifest' THEN CASE WHEN manifest THEN 'keep' ELSE 'trash' END
    WHEN verdict = 'files' THEN CASE WHEN place = 1 THEN 'keep' WHEN files = 0 THEN 'trash' ELSE 'none' END ELSE 'none' END AS advice,
    CASE WHEN verdict = 'stale' THEN filled >= 2 ELSE verdict = 'manual' END AS several_filled, verdict IN ('stale', 'manual') AS by_hand, verdict = 'stale' AS stale FROM v""")
def folder_advice(read):
    """Which of the folders of one name to keep: of the group's aggregates, joined back to its folders.

    Two manifests, or a manifest and files elsewhere, or files in two folders, are for a person; else the folder with
    the manifest stays, or that with most files, ties to the oldest (unknown last) and then the smallest id.
    """
    id_ = F.col("c_custkey")
    created = F.when(id_ % 9 != 0, (id_ * 37) % 1000)
    rows = read("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), id_.alias("id"), F.when(id_ % 4 == 0, id_ % 7).otherwise(0).alias("files"), (id_ % 11 == 0).alias("manifest"), created.alias("created"))
    best = F.struct((-F.col("files")).alias("f"), F.col("created").isNull().alias("u"), F.col("created").alias("c"), F.col("id").alias("id"))
    groups = rows.groupBy("nation", "segment").agg(
        F.count_if(F.col("files") > 0).alias("filled"), F.count_if("manifest").alias("manifests"), F.count_if((F.col("files") > 0) & ~F.col("manifest")).alias("others"), F.min(best)["id"].alias("best")
    )
    with_manifest = F.when(F.col("manifests") >= 2, "stale").when((F.col("manifests") == 1) & (F.col("others") == 0), "manifest")
    groups = groups.withColumn("verdict", with_manifest.when((F.col("manifests") == 1) | (F.col("filled") >= 2), "manual").otherwise("files"))
    keep = F.when(F.col("verdict") == "manifest", F.col("manifest")).when(F.col("verdict") == "files", F.col("id") == F.col("best"))
    trash = (F.col("verdict") == "manifest") | ((F.col("verdict") == "files") & (F.col("files") == 0))
    return rows.join(groups, ["nation", "segment"]).select(
        "nation",
        "segment",
        "id",
        F.when(keep, "keep").when(trash, "trash").otherwise("none").alias("advice"),
        F.when(F.col("verdict") == "stale", F.col("filled") >= 2).otherwise(F.col("verdict") == "manual").alias("several_filled"),
        F.col("verdict").isin("stale", "manual").alias("by_hand"),
        (F.col("verdict") == "stale").alias("stale"),
    )


LOG = [
    (1, 1, "=== 📘 [7] Algebra (12.5MB) ==="),
    (1, 2, "  ✔ 40 페이지 — OCR 시작"),
    (1, 3, "[page 1/40] ✓"),
    (1, 4, "note"),
    (1, 5, "[page 2/40] ✗ timeout"),
    (1, 6, "  ▷ Drive: done"),
    (1, 7, " [skip] Geometry"),
    (1, 8, "=== 📘 [8] Calculus [2] (3MB) ==="),
    (1, 9, "[page 3/9] ✓ === 📘 [9] x (1MB) ==="),
    (2, 1, "[page 5/6] ✓"),
    (2, 2, None),
    (2, 3, "x [skip] not at the start"),
]
#: Fixed formats of the log's lines.
BOOK, TOTAL, PAGE, DONE = r"=== 📘 \[(.+?)\] (.+?) \(.+?MB\) ===", r"^\s*✔ (\d+) 페이지 — OCR 시작", r"\[page (\d+)/(\d+)\] ([✓✗])", r"^\s*(\[skip\]|▷ Drive:)"


@query(f"""WITH k AS (SELECT *, CASE WHEN regexp_matches(line, '{BOOK}') THEN 'book' WHEN regexp_matches(line, '{TOTAL}') THEN 'total' WHEN regexp_matches(line, '{PAGE}') THEN 'page'
    WHEN regexp_matches(line, '{DONE}') THEN 'done' END AS kind FROM {carried(LOG, "run, no, line", line=some_after("line"))}),
    e AS (SELECT *, CASE WHEN kind = 'book' THEN regexp_extract(line, '{BOOK}', 1) END AS f, CASE WHEN kind = 'book' THEN regexp_extract(line, '{BOOK}', 2) END AS b,
    CASE kind WHEN 'book' THEN 0 WHEN 'page' THEN CAST(regexp_extract(line, '{PAGE}', 1) AS INT) END AS p, CASE kind WHEN 'book' THEN 0 WHEN 'total' THEN CAST(regexp_extract(line, '{TOTAL}', 1) AS INT) END AS t,
    kind = 'page' AND regexp_extract(line, '{PAGE}', 3) = '✓' AS good FROM k)
    SELECT CAST(run AS BIGINT) AS run, CAST(no AS BIGINT) AS no, last_value(f IGNORE NULLS) OVER w AS folder, last_value(b IGNORE NULLS) OVER w AS book, coalesce(last_value(p IGNORE NULLS) OVER w, 0) AS page,
    coalesce(last_value(t IGNORE NULLS) OVER w, 0) AS pages, count(*) FILTER (WHERE good) OVER w AS succeeded, count(*) FILTER (WHERE kind = 'page' AND NOT good) OVER w AS failed,
    count(*) FILTER (WHERE kind = 'done') OVER w AS finished FROM e WINDOW w AS (PARTITION BY run ORDER BY no ROWS UNBOUNDED PRECEDING)""")
def run_progress(read):
    """The state of a run after each line of its log: the last book, page and total, and running counts."""
    has = lambda p: F.col("line").rlike(p)
    part = lambda p, i: F.regexp_extract("line", p, i)
    rows = carry(read, LOG, "run long, no long, line string", line=some_after("line")).withColumn("kind", F.when(has(BOOK), "book").when(has(TOTAL), "total").when(has(PAGE), "page").when(has(DONE), "done"))
    is_ = lambda k: F.col("kind") == k
    good = is_("page") & (part(PAGE, 3) == "✓")
    w = W.partitionBy("run").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    return rows.select(
        "run",
        "no",
        last(F.when(is_("book"), part(BOOK, 1))).alias("folder"),
        last(F.when(is_("book"), part(BOOK, 2))).alias("book"),
        F.coalesce(last(F.when(is_("book"), 0).when(is_("page"), part(PAGE, 1).cast("int"))), F.lit(0)).alias("page"),
        F.coalesce(last(F.when(is_("book"), 0).when(is_("total"), part(TOTAL, 1).cast("int"))), F.lit(0)).alias("pages"),
        F.count_if(good).over(w).alias("succeeded"),
        F.count_if(is_("page") & ~good).over(w).alias("failed"),
        F.count_if(is_("done")).over(w).alias("finished"),
    )


@query("""SELECT event_id, coalesce(nullif(CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '' ELSE event_type END, ''), 'unknown') AS model, n AS units, NOT coalesce(event_id % 6 = 0 AND event_id % 4 = 0, false) AS ok,
    CAST(CAST(n * 0.001250 AS DECIMAL(18,6)) AS DOUBLE) AS est_cost_usd FROM (SELECT *, CASE WHEN value > 0 THEN greatest(0, CAST(floor(value) AS BIGINT)) ELSE 1 END AS n FROM events)""")
def logged_calls(read):
    """Calls as they are logged: whole units where positive, else one; an unnamed model is unknown; cost to six places."""
    id_ = F.col("event_id")
    named = F.when(id_ % 13 == 0, None).when(id_ % 17 == 0, "").otherwise(F.col("event_type"))
    units = F.when(F.col("value") > 0, F.floor("value")).otherwise(F.lit(1)).cast("long")
    model = F.coalesce(F.when(named != "", named), F.lit("unknown"))
    cost = (units.cast("decimal(12,0)") * F.lit("0.001250").cast("decimal(7,6)")).cast("decimal(18,6)").cast("double")
    return read("events").select("event_id", model.alias("model"), units.alias("units"), F.coalesce(~((id_ % 6 == 0) & (id_ % 4 == 0)), F.lit(True)).alias("ok"), cost.alias("est_cost_usd"))


PIECES = """SELECT l_orderkey AS page, l_partkey AS piece, l_suppkey AS sup, l_linenumber AS line, CASE WHEN l_linenumber % 5 <> 0 THEN l_suppkey * 3 END AS x0, CASE WHEN l_linenumber % 5 <> 0 THEN l_partkey % 97 END AS y0,
    l_suppkey * 3 + CAST(l_quantity AS BIGINT) AS x1, l_partkey % 97 + l_linenumber - 3 AS y1,
    CASE WHEN l_suppkey % 2 = 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN l_suppkey % 10 END AS printed, CASE WHEN l_suppkey % 7 = 0 THEN 70 END AS answer, CASE WHEN l_suppkey % 5 = 0 THEN l_linenumber END AS question FROM lineitem"""


def pieces(read):
    sup, line, part = F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey")
    has = line % 5 != 0
    return read("lineitem").select(
        F.col("l_orderkey").alias("page"),
        part.alias("piece"),
        sup.alias("sup"),
        line.alias("line"),
        F.when(has, sup * 3).alias("x0"),
        F.when(has, part % 97).alias("y0"),
        (sup * 3 + F.col("l_quantity").cast("long")).alias("x1"),
        (part % 97 + line - 3).alias("y1"),
        F.when((sup % 2 != 0) & (sup % 3 == 0), sup % 10).alias("printed"),
        F.when(sup % 7 == 0, 70).alias("answer"),
        F.when(sup % 5 == 0, line).alias("question"),
    )


@query(f"""SELECT page, piece, sup, line, row_number() OVER (PARTITION BY page ORDER BY coalesce(y0, 1e9), coalesce(x0, 1e9), line, piece, sup, x1) AS place FROM ({PIECES})""")
def reading_order(read):
    """The pieces of a page from top to bottom and left to right, those without a box last."""
    key = [F.asc_nulls_last("y0"), F.asc_nulls_last("x0"), "line", "piece", "sup", "x1"]
    return pieces(read).select("page", "piece", "sup", "line", F.row_number().over(W.partitionBy("page").orderBy(*key)).alias("place"))


@query(f"""SELECT page, CAST(coalesce(printed, answer, question) AS BIGINT) AS owner, count(*) AS n, min(x0) FILTER (WHERE x1 > x0 AND y1 > y0) AS x0, min(y0) FILTER (WHERE x1 > x0 AND y1 > y0) AS y0,
    max(x1) FILTER (WHERE x1 > x0 AND y1 > y0) AS x1, max(y1) FILTER (WHERE x1 > x0 AND y1 > y0) AS y1 FROM ({PIECES}) GROUP BY 1, 2""")
def owner_boxes(read):
    """The box around the proper boxes of each owner's pieces; the owner is the printed, answered or asked number."""
    proper = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    rows = pieces(read).withColumns({"owner": F.coalesce("printed", "answer", "question").cast("long"), **{c: F.when(proper, F.col(c)) for c in ("x0", "y0", "x1", "y1")}})
    return rows.groupBy("page", "owner").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
