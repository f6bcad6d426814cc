"""The corpus pipeline over documents: five stages, each written as Parquet and read again by the next.

toxicity        fits on labels, rejects documents that score as toxic
quality_rules   fits on labels, rejects documents that fail a rule or are mostly boilerplate
near_dedup      keeps of each SimHash group the document with the smallest id
mixing          repeats or leaves out documents so that domains meet their target weights
bpe             encodes what is left and decodes it again: one row per document

Null and empty texts are not toxic by themselves and are then rejected by the quality rules. An empty
table gives an empty result. Extra columns of documents go through all stages but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wordmill.llm import bpe, mixing, quality, simhash, toxicity
from wordmill.llm.common import shared_folder, small_batches


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, _labels(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.first_of_groups(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, _labels(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("bpe", encode),
]

#: None of the trained or iterative stages can be written as SQL; tests hold them against other computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
