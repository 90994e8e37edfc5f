"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before it kept; the results lie as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import attention, near_copies, packing, quality_rules, suffix_trees
from tidemark.llm.common import new_folder
from tidemark.llm.queries import GOOD, table, vocabulary
from tidemark.storage import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    ship_package(spark)
    return quality_rules.keep_good(docs).select(*COLUMNS)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good.

    It is fitted on the labelled documents of the whole table: the rules before it leave hardly any with label 0.
    """
    ship_package(spark)
    model = attention.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return attention.keep_good(docs, model, GOOD).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id."""
    ship_package(spark)
    return near_copies.keep_one(docs).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand earlier in the corpus; others keep their text as it is."""
    ship_package(spark)
    cut = suffix_trees.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    ship_package(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("quality classifier", classifier_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: Fingerprints and learned scores can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
