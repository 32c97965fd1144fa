"""The corpus pipeline: documents through five stages, each written as Parquet and reread.

Quality classifier (rejected documents go), near duplicates (one document of each component
stays), benchmark decontamination (leaking documents go), mixing to target weights (documents
repeat) and K-d tree sharding. All but the last return the columns of documents.

Every stage takes nulls in any column, repeated rows, columns of any name and empty tables; what it
does with them stands in its text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import decontaminate, kdshard, mixing, neardup, quality
from framewright.llm.common import read_table, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null texts are judged as empty ones, null ids and very
    long texts like others; repeated rows stay or go together; without labels all rows stay."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id; of an id's repeated rows
    one stays. Null and empty texts are like no other text and stay, as do all rows without an id."""
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; null ids are judged like others;
    repeated rows stay or go together; without items all rows stay."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"), short=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the document on a source's edge gives its first words. Null
    sources are one source, null ids one id of the order; null and empty texts have no words and come only
    with whole repetitions of their source; equal rows are rows of their own."""
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and slot. Null texts are empty ones; null languages, sources and ids are values
    of their own; equal texts share a shard."""
    return kdshard.shard_documents(docs)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one), ("decontamination", drop_leaks), ("mixing", mix), ("sharding", shard)]

#: The learnt classifier and the tree's splits are not SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
