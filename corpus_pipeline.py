"""The training-data pipeline: quality rules, toxicity, line dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import linededup, packing, quality, simhash, toxicity
from tessera.llm.common import materialize, stage_tables, table, unused
from tessera.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def staged(f: Stage) -> Stage:
    """The stage, whose intermediate tables go when the next one begins; its result is to be written before."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_tables(spark, docs):
            return f(spark, docs, sf_dir)

    return run


@staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the robust outlier test; each row is judged by its own text.

    Null and empty texts fail the base rules.  Rows of a repeated or null doc_id are judged apart; all columns stay.
    """
    return quality.passing(docs)


@staged
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; each row is judged by its own text.

    Null and empty texts are not toxic.  Without labels of both kinds all rows stay; all columns stay.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


@staged
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; n_chars, where docs has it, follows the text.

    A document that had nothing else goes; null and empty texts stay as they are, and so do all columns.
    """
    removed = unused(docs.columns, "lines_removed")
    out = linededup.line_dedup(docs, removed=removed)
    out = out.where((F.col(removed) == 0) | F.col("text").rlike(quality.WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@staged
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words and a similarity of 0.8.

    Texts without a word are one group; the smallest doc_id stays, nulls last; all columns stay.
    """
    return simhash.deduplicate(docs, size=5, least_similarity=0.8)


@staged
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, in the sources' proportions; a null text is packed as an empty one."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: No stage but the first can be expressed in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
