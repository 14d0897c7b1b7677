"""From raw documents to packed training sequences, a stage after another.

A stage takes the session, what the stage before left, and the folder of the tables. All but the last return the columns of
documents; between stages the rows are cut from their lineage in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumengraph.llm import common, language_id, mixing, near_dedup, packing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language's contexts explain better than letters alone would go; the others carry the language found."""
    return language_id.keep_identified(docs, language_id.train(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays."""
    return near_dedup.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are chosen, and repeated, until the sources have their target weights."""
    return mixing.select(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or piece of one, lies in which training sequence."""
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("near_dedup", remove_near_duplicates), ("source_mixing", mix_sources), ("packing", pack_sequences)]
#: None of the stages can be written in SQL; tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
