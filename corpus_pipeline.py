"""From raw documents to packed training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomtable.llm import neardup, packing, quality, repeats, rules
from loomtable.llm.common import load, remove, shared_folder
from loomtable.llm.queries import BYTE_BPE, BYTE_BPE_FILE

#: Bytes from which a repeated string is cut: passages of over 50 words are longer (the shortest of 51 words in the
#: benchmark table has 271 bytes).
PASSAGE = 240


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores 0.3 or more; it learns from the labelled ones among docs."""
    field = quality.train(*quality.columns(quality.training_rows(docs, load(spark, sf_dir, "labels"))))
    return quality.keep_good(docs, field)


def pass_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    return rules.keep_passing(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated strings of PASSAGE bytes or more."""
    return repeats.without_repeats(docs, PASSAGE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, added=packing.added_tokens(public_tokenizers.path(BYTE_BPE_FILE)))


STAGES = [("quality", good_quality), ("rules", pass_rules), ("near_duplicates", one_of_each), ("repeats", cut_repeats), ("packing", packed)]

#: SQL can't express the trained stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; their results are tables in the shared folder, each removed once the next is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = load(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
