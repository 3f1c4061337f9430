"""The corpus pipeline: each stage works on all that the one before it kept.

``run`` writes each stage's rows as Parquet in the shared folder and reads
them again for the next. All stages but the last return the columns of
``documents``; the last adds what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemstats.llm import decontaminate, exact_dedup, mixing, quality, simhash
from gemstats.llm.common import table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.7 go."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality as label")
    return quality.keep_good(docs, labels, threshold=0.7)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component, the document with the smallest id stays."""
    return simhash.simhash_dedup(docs, shingle=4, distance=4)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target,
    taken (words, repeats counted) and copies."""
    own = ["size", "source_size", "target", "taken", "copies"]
    taken = mixing.mix(docs).filter("copies > 0").select(F.col("mark").alias("__mark"), *own).dropDuplicates(["__mark"])
    return (docs.drop(*own).withColumn("__own", F.xxhash64("doc_id", "source", "text"))
            .join(taken, F.col("__own") == F.col("__mark")).drop("__own", "__mark"))


STAGES = [("quality", good), ("exact_dedup", exact), ("simhash", near), ("decontaminate", clean), ("mixing", mixed)]

#: SQL can't express the classifier, the fingerprints or the alignment.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
