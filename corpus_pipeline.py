"""Corpus preparation in stages; each stage is one of the operators of ``tideline.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import byte_bpe, jaccard, mixing, quality, toxicity
from tideline.llm.common import held_out, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the adaptive thresholds reject."""
    return quality.keep_good(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted toxic; learned from labelled documents of the training folds."""
    network = toxicity.train(docs.where(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return toxicity.score(rows, network).where("predicted = 0").select("__row.*")


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    return jaccard.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in whole copies."""
    return mixing.repeat_mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their texts, and the digests of ids and decoded bytes."""
    return byte_bpe.round_trip(docs, ids="ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_quality),
    ("toxicity", not_toxic),
    ("jaccard_join", no_near_duplicates),
    ("source_mix", mixed),
    ("byte_bpe", encoded),
]

#: Toxicity scores and BPE ids cannot be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
