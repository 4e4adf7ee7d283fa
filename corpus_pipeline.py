"""A training corpus from `documents`: good texts, each once, near copies dropped, sources mixed to their weights, packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of documents.
Nulls, ties, repeated rows and empty tables: as each operator defines them. A document that the mix takes several times comes several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import exact_dedup, fast_minhash, mixing, ordinal_quality, packing
from tallyframe.llm._base import written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ordinal_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fast_minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality classifier", good), ("exact dedup", once), ("minhash near-dedup", distinct), ("source mix", mixed), ("best-fit packing", packed)]

#: The tokenizer and the classifier have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
