"""Queries of the numbered operators over their whole tables, and SQL for them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive, bpe, collocation, divergence, linededup, lm, mixture, packing, permutation, quality, simhash, tokencount, toxicity
from .common import table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; another may be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, most=3)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.katz_scores(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_simhash, op3_nearest, op4_line_dedup, op5_toxicity, op6_archives, op7_token_counts, op8_packing, op9_bpe, op10_katz, op11_divergence, op12_collocations, op13_mixture)
}

ORACLE_SQL: dict[str, str] = {
    "op11_divergence": divergence.SQL,
    "op12_collocations": collocation.SQL,
    "op13_mixture": mixture.SQL,
    "op6_archives": f"""SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
        CASE WHEN copy THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN copy THEN last END AS refers_to
        FROM (SELECT *, strlen(h) >= {archive.REVISIT_FROM} AND page_id < last AS copy FROM
        (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages))"""
}
