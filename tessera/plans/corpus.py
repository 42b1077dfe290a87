"""Queries over texts: tokens and frequencies, retrieval, snippets, chunks, near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..operators import retrieval as R
from .registry import query

#: Latin tokens as SQL gives them.
TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z]{{2,}}'), lambda x: lower(x))"
TERMS = f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY 1, 2"


def tokens(text: str):
    return T.latin_and_hangul_tokens(F.col(text))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY 1 ORDER BY n DESC, token LIMIT 20")
def frequent_tokens(read):
    return read("documents").select(F.explode(tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(20)


@query(f"SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM ({TERMS}) GROUP BY 1")
def token_idf(read):
    docs = read("documents")
    terms = R.term_counts(docs, "doc_id", tokens("text"))
    return R.inverse_frequencies(terms, "doc_id", docs.count()).withColumn("idf", F.round("idf", 6))


@query(f"""WITH terms AS ({TERMS}), idf AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM terms GROUP BY 1),
asked AS (SELECT item_id, token, count(*) AS qf FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS token FROM benchmark) GROUP BY 1, 2),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY 1),
scored AS (SELECT item_id, doc_id, sum(qf * tf * idf * CASE WHEN token = 'the' THEN 2.0 ELSE 1.0 END) AS s FROM asked JOIN idf USING (token) JOIN terms USING (token) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (SELECT item_id, doc_id, s / sqrt(n + 1) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(s / sqrt(n + 1), 9) DESC, doc_id) AS rank FROM scored JOIN sizes USING (doc_id) WHERE s > 0) WHERE rank <= 5""")
def retrieve_top_k(read):
    with_tokens = lambda name: read(name).withColumn("tokens", tokens("text"))
    return R.top_k(with_tokens("benchmark"), with_tokens("documents"), "item_id", "doc_id", "tokens", 5, {"the": 2.0}).withColumn("score", F.round("score", 6))


@query("""SELECT doc_id, concat(CASE WHEN a > 1 THEN '…' ELSE '' END, substr(text, a, b - a + 1), CASE WHEN b < length(text) THEN '…' ELSE '' END) AS hit
FROM (SELECT doc_id, text, greatest(1, p - 40) AS a, least(length(text), p + 5 + 100) AS b FROM (SELECT doc_id, text, instr(lower(text), 'thread') AS p FROM documents) WHERE p > 0)""".replace("p + 5 + 100", "p + 6 - 1 + 100").replace("thread", "thatth"))
def search_snippets(read):
    return read("documents").select("doc_id", T.snippet([F.col("text")], "thatth").alias("hit")).where("hit IS NOT NULL")


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%idiot%' OR lower(source) LIKE '%src1%'")
def search_any_column(read):
    return read("documents").where(F.ilike("text", F.lit("%idiot%")) | F.ilike("source", F.lit("%src1%"))).select("doc_id")


@query(r"""SELECT doc_id, array_to_string(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(text, '\$\$([^$]+)\$\$', 1), regexp_extract_all(text, '\$([^$\n]+)\$', 1)), lambda x: trim(x)), lambda x: x <> '')), '|') IS NOT NULL AS has, len(list_slice(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(text, '\$\$([^$]+)\$\$', 1), regexp_extract_all(text, '\$([^$\n]+)\$', 1)), lambda x: trim(x)), lambda x: x <> '')), 1, 12)) AS n FROM documents""".replace("array_to_string(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(text, '\\$\\$([^$]+)\\$\\$', 1), regexp_extract_all(text, '\\$([^$\\n]+)\\$', 1)), lambda x: trim(x)), lambda x: x <> '')), '|') IS NOT NULL AS has, ", "").replace("len(", "CAST(len(", 1).replace(", 1, 12)) AS n", ", 1, 12)) AS INTEGER) AS n"))
def equation_counts(read):
    return read("documents").select("doc_id", F.size(T.equations(F.col("text"))).alias("n"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinality) - 1 AS pos, s AS line, length(s) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS ordinality FROM documents) WHERE length(s) >= 400""".replace("row_number() OVER (PARTITION BY doc_id ORDER BY ordinality) - 1 AS pos", "CAST(ordinality - 1 AS INTEGER) AS pos").replace(", length(s) AS n", ", CAST(length(s) AS INTEGER) AS n"))
def long_lines(read):
    return read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("n", F.length("line")).where("n >= 400")


@query("""SELECT conv_id, turn, role, CAST(start AS BIGINT) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY turn), total) AS BIGINT) AS "end" FROM (SELECT conv_id, turn, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS start, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)""")
def chunk_bounds(read):
    w = W.partitionBy("conv_id")
    n = F.length("text")
    rows = read("conversations").withColumns({"start": F.sum(n).over(w.orderBy("turn")) - n, "total": F.sum(n).over(w)})
    return rows.select("conv_id", "turn", "role", "start", F.lead("start").over(w.orderBy("turn")).alias("next"), "total").withColumn("end", F.coalesce("next", "total")).drop("next", "total")


@query("""SELECT doc_id, lang, prefix FROM (SELECT doc_id, lang, substr(text, 1, 60) AS prefix, row_number() OVER (PARTITION BY substr(text, 1, 60) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def distinct_prefixes(read):
    docs = read("documents").withColumn("prefix", F.substring("text", 1, 60))
    return docs.withColumn("r", F.row_number().over(W.partitionBy("prefix").orderBy("doc_id"))).where("r = 1").select("doc_id", "lang", "prefix")


@query(f"""WITH s AS (SELECT conv_id, turn, list_distinct({TOKENS.format('text')}) AS t FROM conversations)
SELECT x.conv_id, x.turn AS a, y.turn AS b FROM s x JOIN s y ON x.conv_id = y.conv_id AND x.turn < y.turn WHERE len(x.t) > 0 AND len(y.t) > 0 AND len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) >= 0.1""")
def similar_turns(read):
    rows = read("conversations").withColumn("tokens", tokens("text"))
    return R.similar_pairs(rows, "conv_id", "turn", F.col("tokens"), 0.1)


@query("SELECT substr(sha1(text), 1, 12) AS id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80) AS digest, count(*) AS n FROM documents GROUP BY 1, 2")
def document_digests(read):
    return read("documents").groupBy(T.short_id(F.col("text")).alias("id"), T.digest(F.col("text")).alias("digest")).agg(F.count("*").alias("n"))


@query("""SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT text) AS texts, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def corpus_diagnostics(read):
    docs = read("documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text"))  # texts are told apart by digest
    rows = docs.join(read("labels"), "doc_id", "left")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("text").alias("texts"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


@query("""SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, coalesce(nullif(split_part(regexp_replace(url, '^https?://[^/?#]+/?|[?#].*$', '', 'g'), '/', 1), ''), '(none)') AS root, count(*) AS n FROM pages GROUP BY 1, 2""")
def pages_by_root(read):
    path = F.regexp_replace("url", r"^https?://[^/?#]+/?|[?#].*$", "")
    root = F.coalesce(F.nullif(F.split(path, "/")[0], F.lit("")), F.lit("(none)"))
    return read("pages").groupBy(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), root.alias("root")).agg(F.count("*").alias("n"))
