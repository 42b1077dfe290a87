"""Queries of row-quality rules: error classes, labels that may overlap, issues by rule."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from .registry import query

#: Classes of a text by its first matching pattern.
CLASSES = [("table", r" \| "), ("symbols", r"[#$%&*]{3}"), ("shouting", r"!!"), ("license", r"(?i)licen[cs]e"), ("contact", r"@")]
CASES = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in CLASSES)


@query(f"SELECT class, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id)[1:3], ',') AS examples FROM (SELECT doc_id, CASE {CASES} ELSE 'other' END AS class FROM documents) GROUP BY 1")
def failure_classes(read):
    rows = read("documents").select("doc_id", T.first_matching(F.col("text"), CLASSES, "other").alias("class"))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("class").orderBy("doc_id"))).where("r <= 3")  # three of each task go on
    examples = first.groupBy("class").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("examples"))
    return rows.groupBy("class").agg(F.count("*").alias("n")).join(examples, "class")


@query("SELECT label, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS label FROM documents WHERE regexp_matches(text, '{p}')" for n, p in CLASSES) + ") GROUP BY 1")
def overlapping_labels(read):
    return read("documents").select(F.explode(T.all_matching(F.col("text"), CLASSES)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, code FROM (SELECT doc_id, 'E_CONTENT_SHORT' AS code FROM documents WHERE length(text) < 40 UNION ALL SELECT doc_id, 'E_CONTENT_BANNED' FROM documents WHERE regexp_matches(lower(text), '(idiot|stupid|trash)') UNION ALL SELECT doc_id, 'E_LINE_LONG' FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 2000)) > 0 UNION ALL SELECT doc_id, 'E_ODD_DOLLAR' FROM documents WHERE (length(text) - length(replace(text, '$', ''))) % 2 = 1)""")
def content_gate(read):
    text = F.col("text")
    rules = {
        "E_CONTENT_SHORT": F.length(text) < 40,
        "E_CONTENT_BANNED": F.lower(text).rlike("(idiot|stupid|trash)"),
        "E_LINE_LONG": F.exists(F.split(text, "\n"), lambda x: F.length(x) > 2000),
        "E_ODD_DOLLAR": F.regexp_count(text, F.lit(r"\$")) % 2 == 1,
    }
    issues = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))
    return read("documents").select("doc_id", F.explode(issues).alias("code"))


@query("""SELECT lang, round(count(*) FILTER (r) / count(*), 4) AS rate, CASE WHEN count(*) FILTER (r) / count(*) >= 0.5 THEN 'error' WHEN count(*) FILTER (r) / count(*) >= 0.05 THEN 'warn' ELSE 'ok' END AS severity FROM (SELECT lang, regexp_matches(text, '[#$%&*]{3}') AS r FROM documents) GROUP BY 1""")
def fallback_rates(read):
    rate = F.count_if(F.col("text").rlike("[#$%&*]{3}")) / F.count("*")
    return read("documents").groupBy("lang").agg(F.round(rate, 4).alias("rate"), F.when(rate >= 0.5, "error").when(rate >= 0.05, "warn").otherwise("ok").alias("severity"))


@query("""SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'no_question' WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'no_answer' WHEN max(turn) + 1 <> count(*) THEN 'gap' ELSE 'complete' END AS state FROM conversations GROUP BY 1""")
def completeness(read):
    has = lambda role: F.count_if(F.col("role") == role) == 0
    state = F.when(has("user"), "no_question").when(has("assistant"), "no_answer").when(F.max("turn") + 1 != F.count("*"), "gap").otherwise("complete")
    return read("conversations").groupBy("conv_id").agg(state.alias("state"))
