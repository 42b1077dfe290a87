"""A stored inverted index: postings in blocks with bounds, sources added one by one, top-k that skips blocks.

Each source has tables in a folder of its own: `rows` (key, tokens, counts), a document's distinct tokens and how often it has each;
`blocks` (token, level, chunk, best, entries, size); `documents`, their number.  A posting's impact is tf / root(n + 1), n
being the document's number of distinct tokens, which does not depend on other documents, so adding a source leaves the others as they
are; inverse frequencies are taken from the sizes of the blocks when a query runs.  Blocks hold the postings of a token whose
impacts lie within one level, of the documents that one task took at once, BLOCK at most, so that a token of every document
is many blocks, not one, and postings are not dealt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .joins import by_document, few
from .positions import checkpointed
from .retrieval import distinct_tokens, document_terms, first_by_words, numbered_words, term_counts
from .scoring import blocks_of, known_words

#: Postings of a block, and levels of impact by doubling.
BLOCK, LEVELS = 256, 4
#: All documents are read where they have more postings than these of the tokens that all queries have, on average.
MET = 16
#: What a bound is lowered by, against the rounding of sums.
SLACK = 1e-9


def add_source(docs: DataFrame, key: str, tokens: str, folder: str, source: str) -> None:
    """Write the index of docs (key, and an array of tokens) as that source; the same source again is replaced."""
    spark, path = docs.sparkSession, f"{folder}/source={source}"
    docs.agg(F.count("*").alias("documents")).write.mode("overwrite").parquet(f"{path}/documents")
    document_terms(docs, key, tokens).where(F.size("tokens") > 0).write.mode("overwrite").parquet(f"{path}/rows")
    blocks_of(spark.read.parquet(f"{path}/rows"), BLOCK, LEVELS).write.mode("overwrite").parquet(f"{path}/blocks")


class Index:
    """The sources of a folder as one index of documents."""

    def __init__(self, spark: SparkSession, folder: str, sources: list[str]):
        read = lambda name: reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/source={s}/{name}").withColumn("source", F.lit(s)) for s in sources])
        self.rows, self.blocks, self.documents = (read(name) for name in ("rows", "blocks", "documents"))

    def weights(self, queries: DataFrame, query: str, tokens: str, boosted: dict[str, float] | None = None) -> DataFrame:
        """(query, token, weight): what a posting's impact counts for in each query."""
        n = self.documents.agg(F.sum("documents")).first()[0] or 0
        asked = checkpointed(term_counts(queries, query, F.col(tokens)).withColumnRenamed("tf", "qf"))
        sizes = self.blocks.join(by_document(asked.select("token").distinct()), "token", "left_semi")
        idf = sizes.groupBy("token").agg(F.sum("size").alias("df")).withColumn("idf", F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)
        boost = F.lit(1.0)
        for token, b in (boosted or {}).items():
            boost = F.when(F.col("token") == token, F.lit(b)).otherwise(boost)
        asked = asked.join(idf, "token")
        return checkpointed(asked.select(F.col(query).alias("query"), "token", "qf", "idf", boost.alias("boost"), (F.col("qf") * F.col("idf") * boost).alias("weight")))

    def _heads(self, weights: DataFrame) -> DataFrame:
        """The blocks of the tokens of weights, without their entries."""
        asked = by_document(weights.select("token").distinct())
        return self.blocks.select("source", "token", "level", "chunk", "best", "size").join(asked, "token", "left_semi")

    def needed(self, weights: DataFrame, k: int) -> DataFrame:
        """(query, source, token, level, chunk, weight): the blocks whose documents can be among a query's first k.

        A query's tokens are ordered by the most they can give.  A document whose last token in that order lies in a
        block can't score more than the tokens before give together with the block's best impact; a block below
        the k-th best score of the documents in the first blocks of all tokens is skipped, as its documents are reached through a
        later token, or not wanted.
        """
        heads = self._heads(weights)
        tops = heads.groupBy("token").agg(F.max_by(F.struct("source", "level", "chunk"), "best").alias("top"), F.max("best").alias("most"))
        bounds = weights.join(tops, "token").withColumn("bound", F.col("weight") * F.col("most"))
        before = F.sum("bound").over(W.partitionBy("query").orderBy("bound", "token")) - F.col("bound")
        bounds = checkpointed(bounds.withColumn("before", before))
        seen = self._entries(bounds.select("query", "token", "weight", "top.*"))
        placed = self._scored(seen, weights)
        placed = placed.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))).where(F.col("rank") <= k)
        least = placed.where(F.col("rank") == k).select("query", (F.col("score") * (1 - SLACK) - SLACK).alias("least"))
        asked = bounds.join(least, "query", "left").select("query", "token", "weight", "before", F.coalesce("least", F.lit(0.0)).alias("least"))
        return asked.join(heads, "token").where(F.col("before") + F.col("weight") * F.col("best") >= F.col("least")).select("query", "source", "token", "level", "chunk", "weight", "size")

    def _entries(self, wanted: DataFrame) -> DataFrame:
        """The documents of wanted blocks, each with the queries that want it: (source, key, queries).

        A block is read once, with all its queries beside it.
        """
        block = ["source", "token", "level", "chunk"]
        asked = wanted.groupBy(*block).agg(F.array_sort(F.collect_set("query")).alias("queries"))
        found = asked.join(self.blocks.select(*block, "entries"), block).select("source", F.explode("entries.key").alias("key"), "queries")
        # equal lists of queries are one before they are put together
        lists = found.groupBy("source", "key", "queries").agg(F.lit(1).alias("one"))
        return lists.groupBy("source", "key").agg(F.array_distinct(F.flatten(F.collect_list("queries"))).alias("queries"))

    def _scored(self, candidates: DataFrame, weights: DataFrame) -> DataFrame:
        """Whole scores of candidates (source, key, queries), by (query, source, key).

        A document meets the list of its queries, and the queries' tokens go to its terms.
        """
        found = self.rows.join(by_document(checkpointed(candidates)), ["source", "key"])
        terms = found.select("source", "key", "queries", F.size("tokens").alias("n"), F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
        terms = terms.select("source", "key", "queries", "n", F.col("t.tokens").alias("token"), F.col("t.counts").alias("tf"))
        asked = terms.join(by_document(weights), "token").where(F.array_contains("queries", F.col("query")))
        total = F.sum(F.col("qf") * F.col("tf") * F.col("idf") * F.col("boost")) / F.sqrt(F.max("n") + 1)
        return asked.groupBy("query", "source", "key").agg(total.alias("score"))

    def _of_all(self, weights: DataFrame, k: int) -> DataFrame:
        """top_k by the whole scores of all documents; each task leaves out those that can't be among a query's first k."""
        words = distinct_tokens(weights)
        asked = checkpointed(numbered_words(weights.withColumnRenamed("query", "_by"), "_by", words))
        held = known_words(self.rows, words)
        return first_by_words(held, asked, "_by", ["key", "source"], k).withColumnRenamed("_by", "query")

    def _meets_all(self, weights: DataFrame) -> bool:
        """Whether the tokens of weights have so many postings that it is less work to read all documents than blocks of them."""
        postings = self._heads(weights).agg(F.sum("size")).first()[0] or 0
        return postings > MET * (self.documents.agg(F.sum("documents")).first()[0] or 0)

    def top_k(self, weights: DataFrame, k: int, needed: DataFrame | None = None) -> DataFrame:
        """(query, rank, source, key, score): the k best documents of each query, ties to the smaller key.

        score is the sum of qf * tf * idf * boost over the root of the document's distinct tokens + 1.  The blocks are those
        needed, but for so many tokens that nearly all documents are met again and again; then all are scored.
        """
        if needed is None and few(weights) and self._meets_all(weights):
            return self._of_all(weights, k).select("query", "rank", "source", "key", "score")
        wanted = self.needed(weights, k) if needed is None else needed
        scored = self._scored(self._entries(wanted), weights).where("score > 0")
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "key", "source"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "source", "key", "score")
