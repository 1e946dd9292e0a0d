"""The corpus pipeline: quality, toxicity, near-duplicates, mixing, packing, each a whole pass over what the one before kept.

run() writes each stage as Parquet in the shared folder and reads it again, so a lost
executor repeats a part of one stage only. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import mixing, neardup, packing, quality, toxicity
from larkspur.llm.common import keep, table

#: Percent of shingles that near-duplicates share.
SIMILAR = 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return neardup.keep_one(docs, SIMILAR)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows = mixing.mix(docs.select(F.struct("*").alias("row"), "doc_id", "source", "text"))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return packing.pack(docs)


STAGES = [("quality", good), ("toxicity", civil), ("near_dedup", distinct), ("mixing", mixed), ("packing", packed)]
#: The classifiers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, f"stage-{name}")
    return docs
