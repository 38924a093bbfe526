"""From raw documents to a token file: five stages, each written and read again as Parquet."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import decontaminate, mixing, quality, simhash, token_files
from gradeloom.llm.queries import known_languages
from gradeloom.llm.shared import table, work_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much text of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that languages approach their target share."""
    return mixing.mixed(docs, known_languages(docs, table(spark, sf_dir, "labels")))


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token file and list its documents as read back from it."""
    file = token_files.write_tokens(
        docs, token_files.new_path(spark), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_digests(spark, file)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", to_target_weights),
    ("token-ID / binary output", token_file),
]

# Classifiers and code tables cannot be expressed in SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{work_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
