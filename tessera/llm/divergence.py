"""Source divergence audit: how far the term shares of a language's sources lie apart, by wide term vectors.

Tasks count terms block by block; the counts of a kept term become one array with a place for each source of its
language.  Higher-order functions turn counts into shares and shares into the contributions of all pairs of sources,
which are summed where they arise before a shuffle sees them.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blocks import blocks, codes, kinds, words_of
from .common import join_counted, materialize, small_batches

#: Bytes outside terms: all of ASCII but letters.
OUTSIDE = kinds(bytes(b for b in range(128) if not chr(b).isalpha()))
#: Documents of its language that a kept term occurs in, at least.
LEAST_DOCUMENTS = 10
#: A share of 1; shares are whole parts of it.
UNIT = 1_000_000_000
#: Ranks of part `term`.
TERMS = 10
#: Bytes of text of a block: the larger, the fewer counts a term has.
BLOCK = 8 << 20


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By block: (lang, source, term, n, documents)."""
    for rows in blocks(batches, "text", BLOCK):
        words, ids, row, _ = words_of(rows.column("text"), OUTSIDE)
        if not len(ids):
            continue
        groups, group = codes(rows.column("lang"), rows.column("source"))
        wide = np.int64(len(words))
        cells, n = np.unique(group[row] * wide + ids, return_counts=True)
        seen = np.unique(row.astype(np.int64) * wide + ids)
        _, documents = np.unique(group[seen // wide] * wide + seen % wide, return_counts=True)  # the same cells in the same order
        of, term = cells // wide, cells % wide
        names = [g.take(pa.array(of)) for g in groups]
        texts = words.take(pa.array(term)).cast(pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*names, texts, pa.array(n, pa.int64()), pa.array(documents, pa.int64())], names=["lang", "source", "term", "n", "documents"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents) of all texts; documents is the number of rows that hold the term."""
    small_batches(docs.sparkSession)
    cells = docs.mapInArrow(_count, "lang string, source string, term string, n long, documents long")
    return cells.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _share(n: Column, whole: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (whole + 2 * terms)), with a product in decimals, as it may pass 64 bits."""
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)"), (whole + 2 * terms).cast("decimal(19,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); squares of shares stay below 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): sources by their distance from each source, and its overused terms.

    A share is that of a kept term (one in at least least_documents rows of its language) among all occurrences of
    kept terms, smoothed by 2.  Part `pair` ranks every other source of the language, part `term` the first terms whose
    share in the source is above that in the language.  Null text, lang and source are ''.  Repeated rows count each.
    A language without kept terms has pairs of value 0 and no terms; an empty table gives an empty result.  Further
    columns are not read.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    cells = term_counts(docs)
    sparse = cells.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("cells"))
    sparse = materialize(sparse.where(F.col("documents") >= least_documents).drop("documents"), "divergence-terms")

    # one row a language: its sources in order, and the sums by source and over all
    occurring = docs.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n"))
    kept = sparse.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sums = occurring.unionByName(kept).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("s"), F.sum("n").alias("whole"))
    by_lang = by_lang.select("lang", F.col("s.source").alias("sources"), F.col("s.n").alias("wholes"), "whole")
    sizes = sparse.groupBy("lang").agg(F.count("*").alias("terms"))
    langs = materialize(by_lang.join(sizes, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0))), "divergence-sources")

    n_terms = langs.agg(F.sum("terms")).first()[0] or 0
    vectors = join_counted(sparse, langs.withColumn("of_lang", F.col("terms")), ["lang"], "of_lang", n_terms)
    counts = F.transform("sources", lambda s: F.coalesce(F.try_element_at(F.map_from_entries("cells"), s), F.lit(0)))
    vectors = vectors.withColumn("counts", counts).withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    shares = F.zip_with("counts", "wholes", lambda n, whole: _share(n, whole, F.col("terms")))
    vectors = vectors.select("lang", "term", "counts", shares.alias("p"), _share(F.col("total"), F.col("whole"), F.col("terms")).alias("q"))
    vectors = materialize(vectors, "divergence-vectors")
    names = langs.select("lang", F.posexplode("sources").alias("i", "source"))

    one = vectors.select("lang", "p", F.posexplode("p").alias("i", "x"))
    two = one.select("lang", "i", F.posexplode(F.expr("transform(slice(p, i + 2, size(p)), y -> (x - y) * (x - y) div (x + y))")).alias("ahead", "value"))
    summed = two.groupBy("lang", "i", (F.col("i") + F.col("ahead") + 1).alias("j")).agg(F.sum("value").alias("value"))
    both = summed.union(summed.select("lang", F.col("j"), F.col("i"), "value"))
    every = langs.select("lang", "sources", F.posexplode("sources").alias("i", "source")).select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    pairs = every.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    of_source = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    each = vectors.select("lang", "term", "q", F.posexplode(F.arrays_zip("counts", "p")).alias("i", "s")).where("s.counts > 0 AND s.p > q")
    used = each.select("lang", "i", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("s.p"), F.col("q")).alias("value"))
    first = used.withColumn("rank", F.row_number().over(W.partitionBy("lang", "i").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= terms)
    return pairs.withColumn("rank", F.row_number().over(of_source)).unionByName(first.join(names, ["lang", "i"]).drop("i"))


#: The rows of op11 by DuckDB.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS n FROM gn GROUP BY 1),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS cnt, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (gn.n + 2 * v.v) AS BIGINT) AS p
    FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN gn USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (sum(cnt) + 2) // (any_value(ln.n) + 2 * any_value(v.v)) AS BIGINT) AS q FROM p JOIN ln USING (lang) JOIN v USING (lang) GROUP BY ALL),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE cnt > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {TERMS}"""
