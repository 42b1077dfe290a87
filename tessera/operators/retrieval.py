"""Retrieval: inverted statistics, weighted term overlap, near-duplicate groups within an owner."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .alike import compared
from .joins import by_document, few
from .positions import checkpointed, written
from .scoring import counted_words, first_of_task, term_lists


def term_counts(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, token, tf)."""
    return docs.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def inverse_frequencies(terms: DataFrame, key: str, n_docs: int | Column) -> DataFrame:
    """(token, df, idf) with idf = ln((N + 1) / (df + 1)) + 1."""
    df = F.count("*")  # terms has one row per document and token
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return terms.groupBy("token").agg(df.alias("df")).withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)


def by_occurrence(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other row has; those of other keys and of null, None if there are none."""
    repeated = checkpointed(docs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1 OR _key IS NULL").select("_key"))
    if repeated.isEmpty():
        return docs, None
    same, asked = F.col(key).eqNullSafe(F.col("_key")), by_document(repeated)
    return docs.join(asked, same, "left_anti"), docs.join(asked, same, "left_semi")


def document_words(docs: DataFrame, key: str, tokens: str, words: pa.Array) -> DataFrame:
    """(key, distinct, words, counts), a row a key: its number of distinct tokens, and how often it has which of the words, by their places.

    Rows of keys that occur once are counted where they are; only those of other keys, and of null, are dealt.
    """
    once, several = by_occurrence(docs, key)
    counted = counted_words(once, key, tokens, words)
    if several is None:
        return counted
    places = docs.sparkSession.createDataFrame(pa.table({"token": words, "place": pa.array(range(len(words)), pa.int32())}))
    terms = term_counts(several, key, F.col(tokens)).join(F.broadcast(places), "token", "left")
    held = F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", F.col("tf").cast("int").alias("tf")))))
    merged = terms.groupBy(key).agg(F.count("*").cast("int").alias("distinct"), held.alias("held"))
    return counted.union(merged.select(key, "distinct", F.col("held.place").alias("words"), F.col("held.tf").alias("counts")))


def document_terms(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, tokens, counts), a row a key: its distinct tokens, and how often it has each."""
    once, several = by_occurrence(docs, key)
    counted = term_lists(once, key, tokens)
    if several is None:
        return counted
    held = F.sort_array(F.collect_list(F.struct("token", F.col("tf").cast("int").alias("tf"))))
    merged = term_counts(several, key, F.col(tokens)).groupBy(F.col(key).alias("key")).agg(held.alias("held"))
    return counted.union(merged.select("key", F.col("held.token").alias("tokens"), F.col("held.tf").alias("counts")))


def top_k(queries: DataFrame, docs: DataFrame, query_key: str, key: str, tokens: str, k: int, boosted: dict[str, float] | None = None) -> DataFrame:
    """The k best documents of each query: sum of qf * tf * idf * boost over the root of distinct tokens + 1.

    Both sides have an array column tokens.  Scores of 0 are left out; ties go to the smaller key.  What is kept of a
    document are the words that queries have; each task leaves out the documents that can't be among a query's first k,
    and the queries' tokens go to the others, whose scores are summed by document.
    """
    asked = checkpointed(term_counts(queries, query_key, F.col(tokens)).withColumnRenamed("tf", "qf"))
    boost = F.lit(1.0)
    for token, b in (boosted or {}).items():
        boost = F.when(F.col("token") == token, F.lit(b)).otherwise(boost)
    asked = asked.withColumn("boost", boost)
    if not few(asked):
        return _top_k_by_joins(asked, docs, query_key, key, tokens, k)
    words = distinct_tokens(asked)
    held = written(document_words(docs, key, tokens, words).where(F.size("words") > 0))
    idf = inverse_frequencies(held.select(F.explode("words").alias("token")), "token", docs.count()).withColumnRenamed("token", "word")
    return first_by_words(held, weighted(asked, query_key, words, idf), query_key, [key], k)


def weighted(asked: DataFrame, query_key: str, words: pa.Array, idf: DataFrame) -> DataFrame:
    """numbered_words() with the idf of each word."""
    rows = numbered_words(asked, query_key, words).join(idf, "word")
    return checkpointed(rows.select(query_key, "query", "word", "qf", "idf", "boost"))


def distinct_tokens(asked: DataFrame) -> pa.Array:
    """The tokens of asked, which has few rows."""
    return pc.unique(asked.select("token").where("token IS NOT NULL").toArrow().column("token"))


def numbered_words(asked: DataFrame, query_key: str, words: pa.Array) -> DataFrame:
    """asked (query_key, token) with word and query, the numbers of tokens and queries; it has few rows."""
    spark = asked.sparkSession
    ids = asked.select(query_key).distinct().toArrow().column(query_key)
    numbers = spark.createDataFrame(pa.table({"_id": ids, "query": pa.array(range(len(ids)), pa.int32())})).select(F.col("_id").cast(asked.schema[query_key].dataType).alias("_id"), "query")
    places = spark.createDataFrame(pa.table({"token": words, "word": pa.array(range(len(words)), pa.int32())}))
    return asked.join(places, "token").join(numbers, asked[query_key].eqNullSafe(F.col("_id"))).drop("_id")


def first_by_words(held: DataFrame, asked: DataFrame, query_key: str, keys: list[str], k: int) -> DataFrame:
    """(query_key, rank, keys, score) of the k best of held (keys, distinct, words, counts) for the rows of weighted()."""
    weights = asked.select("word", "query", (F.col("qf") * F.col("idf") * F.col("boost")).alias("weight")).toArrow()
    left = first_of_task(held.where(F.col(keys[0]).isNotNull()), weights, k, len(keys))
    scored = sums(left, asked, query_key, keys)
    return ranked(scored, query_key, keys, k)


def sums(held: DataFrame, asked: DataFrame, query_key: str, keys: list[str]) -> DataFrame:
    """(query_key, keys, s, distinct): what documents (keys, distinct, words, counts, queries) have in common with those of their queries."""
    terms = held.select(*keys, "distinct", "queries", F.explode(F.arrays_zip("words", "counts")).alias("t"))
    terms = terms.select(*keys, "distinct", "queries", F.col("t.words").alias("word"), F.col("t.counts").alias("tf"))
    met = terms.join(F.broadcast(asked), "word").where(F.array_contains("queries", F.col("query")))
    weight = F.col("qf") * F.col("tf") * F.col("idf") * F.col("boost")
    return met.groupBy(query_key, *keys).agg(F.sum(weight).alias("s"), F.first("distinct").alias("distinct"))


def ranked(scored: DataFrame, query_key: str, keys: list[str], k: int) -> DataFrame:
    """(query_key, rank, keys, score) from sums s and numbers of distinct tokens."""
    scored = scored.withColumn("score", F.col("s") / F.sqrt(F.col("distinct") + 1))
    r = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), *keys))
    return scored.where("score > 0").withColumn("rank", r).where(F.col("rank") <= k).select(query_key, "rank", *keys, "score")


def _top_k_by_joins(asked: DataFrame, docs: DataFrame, query_key: str, key: str, tokens: str, k: int) -> DataFrame:
    """top_k of so many queries that their tokens can't go to every task: terms are dealt by token."""
    terms = term_counts(docs, key, F.col(tokens))
    idf = inverse_frequencies(terms, key, docs.count())
    sizes = terms.groupBy(key).agg(F.count("*").alias("distinct"))
    weight = F.col("qf") * F.col("tf") * F.col("idf") * F.col("boost")
    scored = terms.join(asked.join(idf, "token"), "token").groupBy(query_key, key).agg(F.sum(weight).alias("s")).join(sizes, key)
    return ranked(scored, query_key, [key], k)


#: Sets of one owner that are compared within a task; an owner with more has blocks, each pair of which is a task.
SETS = 16_384
#: Sets of smaller owners that a task takes, about.
TOGETHER = 4_096


def alike_sets(rows: DataFrame, owner: str, key: str, tokens: str, least: float, long: int | None = None, least_long: float | None = None, contained: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(owner, id, keys): the distinct token sets of each owner, with the keys that have them; (p, q): alike sets by id, the smaller first.

    Alike are sets with a Jaccard similarity of at least least, or least_long if both have long tokens or more; with
    contained, also sets of which the smaller lies in the larger by at least that share.

    By prefix filtering: of sets that have ceil(t * |x|) tokens in common, k are among the first |x| - ceil(t * |x|) + k
    of x in a fixed order, t being the share of |x| that they have in common at least; with contained, only the smaller has
    to have them among its first.  Tokens that are rare in a task come first, so few sets meet at one, and k grows with
    the size, so that what is compared is little more than what is alike.  Equal sets are held once.

    Sets are dealt whole: those of small owners with other owners', those of a large one by pairs of its blocks, in rounds that
    deal no set twice.  So a task holds two blocks at most, what is dealt at once grows as the rows, and the work of an
    owner with the square of its sets, over as many tasks.  Sets are held by 64-bit hashes of their tokens with the owner.
    """
    hashed = F.sort_array(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(owner, t))))
    held = rows.where(F.col(owner).isNotNull() & F.col(key).isNotNull()).select(owner, key, hashed.alias("set")).where(F.size("set") > 0)
    sets = written(held.groupBy(owner, "set").agg(F.sort_array(F.collect_set(key)).alias("keys")).withColumn("id", F.monotonically_increasing_id()))
    large = checkpointed(sets.groupBy(owner).agg(F.count("*").alias("n")).where(F.col("n") > SETS).select(F.col(owner).alias("_owner"), F.ceil(F.col("n") / SETS).cast("int").alias("blocks")))
    buckets = max(1, -(-sets.count() // TOGETHER))
    most = large.agg(F.max("blocks")).first()[0] or 1
    placed = sets.join(F.broadcast(large), F.col(owner) == F.col("_owner"), "left").select("id", "set", "blocks", F.xxhash64(owner).alias("group"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = placed.withColumns({"block": F.coalesce(block, F.lit(0)), "group": F.when(F.col("blocks").isNull(), F.pmod("group", F.lit(buckets))).otherwise(F.col("group"))})
    pairs = None
    for apart in range(most):
        for odd in (0, 1) if apart else (0,):
            a, b = F.struct(F.col("block").alias("a"), F.lit(0).alias("side")), F.struct((F.col("block") - apart).alias("a"), F.lit(1).alias("side"))
            sides = F.array(a) if not apart else F.filter(F.array(a, b), lambda x: (x["a"] % 2 == odd) & (x["a"] >= 0) & (x["a"] + apart < F.col("blocks")))
            dealt = placed.where("blocks IS NOT NULL") if apart else placed
            dealt = dealt.select(F.col("blocks").isNotNull().alias("large"), "group", F.explode(sides).alias("x"), "id", "set").select("large", "group", "x.a", "x.side", "id", "set")
            found = written(dealt.groupBy("large", "group", "a").applyInArrow(compared(apart > 0, least, long, least_long, contained), "p long, q long"))
            pairs = found if pairs is None else pairs.union(found)
    return sets.select(owner, "id", "keys"), pairs


def similar_pairs(rows: DataFrame, owner: str, key: str, tokens: str, least: float, long: int | None = None, least_long: float | None = None, contained: float | None = None) -> DataFrame:
    """(owner, a, b): pairs of keys of one owner whose token sets are alike, as told of alike_sets; copies are all paired."""
    sets, pairs = alike_sets(rows, owner, key, tokens, least, long, least_long, contained)
    copies = sets.where(F.size("keys") > 1).select(owner, F.posexplode("keys").alias("at", "a"), "keys")
    later = F.slice("keys", F.col("at") + 2, F.greatest(F.lit(0), F.size("keys") - F.col("at") - 1))
    side = lambda i, k: sets.select(owner, F.col("id").alias(i), F.explode("keys").alias(k))
    both = pairs.join(side("p", "x"), "p").join(side("q", "y").drop(owner), "q").where("x <> y")
    return copies.select(owner, "a", F.explode(later).alias("b")).union(both.select(owner, F.least("x", "y"), F.greatest("x", "y")))


def similar_groups(rows: DataFrame, owner: str, key: str, tokens: str, least: float) -> DataFrame:
    """(key, component): the least key reachable over similar pairs; keys are unique.  Copies are linked to one of them only."""
    sets, pairs = alike_sets(rows, owner, key, tokens, least)
    first = sets.select("id", F.get("keys", F.lit(0)).alias("k"))
    links = pairs.join(first.toDF("p", "a"), "p").join(first.toDF("q", "b"), "q").select("a", "b")
    copies = sets.where(F.size("keys") > 1).select(F.get("keys", F.lit(0)).alias("a"), F.explode(F.slice("keys", F.lit(2), F.size("keys"))).alias("b"))
    return components(rows.select(key), links.union(copies), key)


def components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, component): the least key reachable, by rounds of label propagation with pointer jumping, each checkpointed.

    Nodes without an edge take no part in the rounds.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").checkpoint()
    labels = both.select(F.col("a").alias(key)).distinct().withColumn("component", F.col(key)).checkpoint()
    while True:
        near = both.join(labels.toDF("b", "c"), "b").groupBy(F.col("a").alias(key)).agg(F.min("c").alias("c"))
        lower = labels.join(near, key, "left").select(key, F.least("component", "c").alias("component"))
        jump = lower.select(F.col(key).alias("component"), F.col("component").alias("up"))
        after = lower.join(jump, "component").select(key, F.least("component", "up").alias("component")).checkpoint()
        if not after.join(labels.toDF(key, "was"), key).where("component <> was").limit(1).count():
            return nodes.join(after, key, "left").select(key, F.coalesce("component", key).alias("component"))
        labels = after
