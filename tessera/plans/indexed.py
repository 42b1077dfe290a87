"""Retrieval through a stored index of two sources; the same rows as by the join of all terms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.index import Index, add_source
from ..operators.positions import checkpoint_folder
from .corpus import tokens
from .registry import ORACLE_SQL, query


@query(ORACLE_SQL["retrieve_top_k"])
def indexed_top_k(read):
    """The five best documents of each benchmark item, from blocks that can hold one of them."""
    checkpoint_folder(read.spark)
    folder = f"{read.spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    docs = read("documents").withColumn("tokens", tokens("text"))
    for source, rows in (("even", docs.where("doc_id % 2 = 0")), ("odd", docs.where("doc_id % 2 <> 0 OR doc_id IS NULL"))):
        add_source(rows, "doc_id", "tokens", folder, source)
    index = Index(read.spark, folder, ["even", "odd"])
    weights = index.weights(read("benchmark").withColumn("tokens", tokens("text")), "item_id", "tokens", {"the": 2.0})
    found = index.top_k(weights, 5)
    return found.select(F.col("query").alias("item_id"), "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
