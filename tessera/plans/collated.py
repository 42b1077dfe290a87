"""Order, groups and joins of names by collation instead of code points."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .registry import query

#: Letters are compared without case and accents, in the order of the root locale.
ALIKE = "UNICODE_CI_AI"
IN_DUCK = "replace(replace(replace(lower(strip_accents(w)), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"
WORDS = "SELECT doc_id, lang, unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents"


def words(read):
    found = read("documents").select("doc_id", "lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    return found.withColumn("name", F.collate("w", ALIKE))


@query(f"SELECT lang, min(w) AS first, count(DISTINCT w) AS spellings, count(*) AS n FROM (SELECT *, {IN_DUCK} AS name FROM ({WORDS})) GROUP BY lang, name")
def collated_groups(read):
    """Words of a language that differ in case and accents only, as one group."""
    spelled = words(read).groupBy("lang", "w").agg(F.count("*").alias("n")).withColumn("name", F.collate("w", ALIKE))
    return spelled.groupBy("lang", "name").agg(F.min("w").alias("first"), F.count("*").alias("spellings"), F.sum("n").alias("n")).drop("name")


@query(f"SELECT lang, w, place FROM (SELECT lang, w, dense_rank() OVER (PARTITION BY lang, substr(name, 1, 2) ORDER BY name) AS place FROM (SELECT DISTINCT lang, w, {IN_DUCK} AS name FROM ({WORDS}))) WHERE place <= 20")
def collated_order(read):
    """The first twenty names under each two letters of a language, in the order of a dictionary."""
    named = words(read).select("lang", "w").distinct().withColumn("name", F.collate("w", ALIKE))
    letters = F.collate(F.expr("substr(replace(replace(replace(lower(w), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 1, 2)"), ALIKE)
    ranked = named.withColumn("place", F.dense_rank().over(W.partitionBy("lang", letters).orderBy("name")))
    return ranked.where("place <= 20").select("lang", "w", F.col("place").cast("long").alias("place"))


@query(f"""SELECT item_id, count(DISTINCT name) AS names, CAST(sum(n) AS BIGINT) AS n FROM (SELECT DISTINCT item_id, {IN_DUCK} AS name FROM (SELECT item_id, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS w FROM benchmark))
JOIN (SELECT {IN_DUCK} AS name, count(*) AS n FROM ({WORDS}) GROUP BY 1) USING (name) GROUP BY 1""")
def collated_matches(read):
    """Words of each benchmark item that documents hold in any case and with any accents, and how often they do."""
    asked = read("benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).distinct()
    asked = asked.withColumn("name", F.collate("w", ALIKE)).groupBy("item_id", "name").agg(F.lit(1).alias("one"))
    # a spelling is counted by its bytes, and only then collated
    spelled = words(read).groupBy("w").agg(F.count("*").alias("n")).withColumn("name", F.collate("w", ALIKE))
    held = spelled.groupBy("name").agg(F.sum("n").alias("n"))
    return asked.join(held, "name").groupBy("item_id").agg(F.count("*").alias("names"), F.sum("n").alias("n"))
