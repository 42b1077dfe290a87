"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  It is posted under its first pivots; a query visits
the postings of its own first pivots, ranks them by the footrule distance of the two orders, and the best are
reranked by the inner product in double precision.  Vectors of different lengths are brought to one sphere by one
more component, so that the nearest on it are those of largest inner product.

Equal vectors are indexed once, with their smallest ids: no more than that many of them can be among
the nearest, as ties go to smaller ids.  Long postings are split into parts, and the queries of a pivot into
blocks; every block visits every part.  A vector that a query meets in several postings is ranked in the first of
them only, so the work is the number of distinct candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, small_batches

#: Pivots: the root of the number of vectors times this, within bounds; bytes of all pivots at most (they are
#: broadcast); pivots of a vector's order.
PIVOTS, LEAST_PIVOTS, MOST_PIVOTS, PIVOT_BYTES, ORDER = 4.5, 32, 32_000, 32 << 20, 64
#: Pivots that a vector is posted under, and that a query visits; share of a posting's new candidates that is
#: reranked, and at least so many; vectors of a part of a posting, and queries of a block.
POSTED, VISITED, RERANK, LEAST_RERANK, PART = 16, 32, 0.3, 200, 8_192


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of finite doubles that are not zero."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~odd).where(F.exists("v", lambda x: x != 0))


def _lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors on the sphere of radius longest, by one more component."""
    return np.hstack([v, np.sqrt(np.maximum(0, longest**2 - (v**2).sum(axis=1)))[:, None]])


def orders(v: np.ndarray, pivots: np.ndarray, longest: float, query: bool, order: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first, ties to smaller numbers."""
    x = np.hstack([v, np.zeros((len(v), 1))]) if query else _lifted(v, longest)
    near = -(x @ pivots.T)  # pivots have equal lengths
    k = min(order, near.shape[1])
    first = np.argpartition(near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(first, np.lexsort((first, np.take_along_axis(near, first, 1)), axis=1), 1)


def places(query: np.ndarray, n_pivots: int) -> np.ndarray:
    """The place of every pivot in an order; a pivot missing from it stands just behind its end."""
    place = np.full(n_pivots, len(query), np.int16)
    place[query] = np.arange(len(query))
    return place


def footrule(place: np.ndarray, stored: np.ndarray, k: int) -> np.ndarray:
    """Footrule distances of an order of k pivots, given by places, to many orders."""
    at = place[stored]
    gaps = np.abs(at - np.arange(stored.shape[1], dtype=np.int16)) + at
    return gaps.sum(axis=1, dtype=np.int32) + k * (k + 1) // 2 - k * stored.shape[1]


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query, nearest first, ties to smaller vec_id.

    vectors has vec_id and embedding; queries likewise, by default the rows whose vec_id is divisible by every.
    A query is no candidate of its own.  Vectors that are null, zero or hold null or non-finite components,
    and null ids, take no part, nor do those of another length than that of the smallest vec_id.  Repeated rows count
    once; of different vectors of one id the least, component by component, counts.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors)
    asked = usable(queries) if queries is not None else rows.where(F.col("vec_id") % every == 0)
    lengths = rows.agg(F.min_by(F.size("v"), "vec_id")).first()[0]
    one_each = lambda d: d.where(F.size("v") == F.lit(lengths)).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows, asked = one_each(rows), one_each(asked)
    # equal vectors once, with their k + 1 smallest ids (the query itself may be among them)
    same = W.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    classes = materialize(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("vec_id", F.col("ids")[0]), "vectors")
    n, longest = classes.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not n:
        return asked.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    most = max(LEAST_PIVOTS, min(MOST_PIVOTS, PIVOT_BYTES // (8 * (lengths + 1))))
    wanted = int(min(most, max(LEAST_PIVOTS, PIVOTS * n**0.5)))
    # twice as many as wanted by hash, and then the wanted ones: no task sends more than its share to the driver
    some = classes.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(min(1, (2 * wanted + 100) / n) * (1 << 40)))
    picked = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("v").collect()
    pivots = _lifted(np.array([r[0] for r in picked]), longest)
    order, m = min(ORDER, len(pivots)), len(pivots)
    sent = spark.sparkContext.broadcast(pivots)

    def ordered(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = np.array(b.column(1).to_pylist(), float)
                    found = orders(v, sent.value, longest, query, order).astype(np.int16)
                    packed = [pa.array([x.tobytes() for x in a], pa.binary()) for a in (v.astype(np.float32), found)]
                    heads = pa.array(found[:, : VISITED if query else POSTED].astype(np.int32).tolist(), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0), *packed, heads], names=["vec_id", "v", "perm", "heads"])

        return run

    schema = "vec_id long, v binary, perm binary, heads array<int>"
    indexed = materialize(classes.select("vec_id", "v").mapInArrow(ordered(False), schema), "permutations")
    asking = materialize(asked.mapInArrow(ordered(True), schema), "permutations")
    posted = indexed.select("vec_id", "v", "perm", F.explode("heads").alias("pivot"))
    visits = asking.select("vec_id", "v", "perm", F.posexplode("heads").alias("pos", "pivot"))
    blocks_of = lambda d, name: d.groupBy("pivot").agg(F.ceil(F.count("*") / PART).cast("int").alias(name))
    # a row a pivot, and pivots are bounded
    sizes = F.broadcast(materialize(blocks_of(posted, "parts").join(blocks_of(visits, "blocks"), "pivot").coalesce(1), "postings"))
    share = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lists = posted.join(sizes, "pivot").select("vec_id", "v", "perm", "pivot", share("parts").alias("part"), each("blocks").alias("block"))
    visits = visits.join(sizes, "pivot").select("vec_id", "v", "perm", "pos", "pivot", share("blocks").alias("block"), each("parts").alias("part"))

    def visit(key: tuple, stored: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)]
        scores = [np.zeros(0, np.float32)]
        if len(stored) and len(queries):
            stored = stored.sort_values("vec_id")
            matrix = lambda column, kind: np.stack([np.frombuffer(x, kind) for x in column])
            ids, v, perms = stored["vec_id"].to_numpy(), matrix(stored["v"], np.float32), matrix(stored["perm"], np.int16)
            heads = np.ascontiguousarray(perms[:, :POSTED])
            for q, x, perm, pos in zip(queries["vec_id"], matrix(queries["v"], np.float32), matrix(queries["perm"], np.int16), queries["pos"], strict=True):
                place = places(perm, m)
                new = np.flatnonzero(place[heads].min(axis=1) >= pos)  # the others were met in an earlier posting
                far = footrule(place, perms[new], len(perm))
                best = new[np.argsort(far, kind="stable")[: max(LEAST_RERANK, k + 1, int(RERANK * len(new)))]]
                score = v[best] @ x
                top = np.lexsort((ids[best], -score))[: k + 1]
                out.append(np.stack([np.full(len(top), q), ids[best[top]]], axis=1))
                scores.append(score[top])
        pairs = np.concatenate(out)
        return pd.DataFrame({"query_id": pairs[:, 0], "cls": pairs[:, 1], "near": np.concatenate(scores)})

    # single precision picks, with room for its rounding; the scores below are in double precision
    near = lists.groupBy("pivot", "part", "block").cogroup(visits.groupBy("pivot", "part", "block")).applyInPandas(visit, "query_id long, cls long, near float")
    near = near.groupBy("query_id", "cls").agg(F.max("near").alias("near"))
    found = near.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "cls"))).where(F.col("r") <= 2 * (k + 1)).select("query_id", "cls")
    pairs = found.join(classes.select(F.col("vec_id").alias("cls"), "ids", F.col("v").alias("w")), "cls").join(asked.select(F.col("vec_id").alias("query_id"), "v"), "query_id")
    score = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.select("query_id", F.explode("ids").alias("vec_id"), score.alias("score")).where("vec_id <> query_id")
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
