"""Curation of a corpus in five stages; each takes what its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``.
SQL can't express the stages (trained models, keyed permutations, seeded draws); tests hold them against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.common import shared_folder, table
from cardloom.llm.decontaminate import find_items
from cardloom.llm.mixing import mix_texts
from cardloom.llm.near_copies import first_of_copies
from cardloom.llm.pii import KINDS, pseudonymise, session_key
from cardloom.llm.toxicity import CATEGORIES, drop_toxic, fit, label_columns


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    chain = fit(docs, label_columns(table(spark, sf_dir, "labels")), CATEGORIES)
    return drop_toxic(docs, chain)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five words, similarity 0.8 or more)."""
    return first_of_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item."""
    return find_items(docs, table(spark, sf_dir, "benchmark"), keep="clean")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the new text."""
    done = pseudonymise(docs, session_key(spark)).drop(*(f"n_{k}" for k in KINDS))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: pieces of documents with their output shard and the key that orders the shard."""
    return mix_texts(docs)


STAGES = [("toxicity", toxicity), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("pii", pii), ("mixing", mixing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
