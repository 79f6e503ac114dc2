"""Corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a DataFrame; all but the last return the columns of documents.  ``run``
writes every stage as Parquet in the cluster's checkpoint folder and hands the
reread frame to the next.

Defined results: a null text fails the quality rules and goes; empty tables
pass through every stage; columns of ``docs`` beyond the known ones stay until
the last stage, whose rows are packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import packing, pii, quality, simhash, suffixes
from riskloom.llm.common import fresh, read, tokenizer
from riskloom.session import ensure_checkpoint_dir, ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned rule go."""
    ship_package(spark)
    (kept,) = fresh(docs, "kept")
    judged = quality.quality(docs, read(spark, sf_dir, "labels"))
    return judged.where(F.col(kept)).select(docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    ship_package(spark)
    return simhash.keep_one(docs, shingle=4, distance=4)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document of smaller id holds are cut."""
    ship_package(spark)
    return suffixes.remove(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    ship_package(spark)
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token pieces packed into sequences of 4096."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

# learned rules, bit-wise fingerprints and token ids have no SQL form; tests hold
# the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
