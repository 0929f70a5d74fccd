"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, counts, langid, neardup, packing, quality, repeats, rules, urls
from .common import hash_part, load, settle

Query = Callable[[SparkSession, str], DataFrame]

#: Vocabularies by name; every executor has the installed files.
BYTE_BPE, BYTE_BPE_MULTI = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"
#: The tokenizer file of BYTE_BPE, for its added tokens.
BYTE_BPE_FILE = "byte_bpe_50k.json"
#: Bytes from which op10 tells of a repeated string that it does not remove, as passages of over 50 words are; the pipeline cuts from here.
PASSAGE = 240


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, added=packing.added_tokens(public_tokenizers.path(BYTE_BPE_FILE)))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages"), urls.train(urls.labelled_urls()))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = counts.sample_edits(load(spark, sf_dir, "documents"))
    return counts.count_with_edits(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    field = quality.train(*quality.columns(quality.training_rows(docs, load(spark, sf_dir, "labels"))))
    scored = quality.score_documents(docs, field)
    return scored.select("doc_id", (hash_part("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.stored_texts(load(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE_MULTI), public_tokenizers.PATTERN)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_policy(rules.ledger(load(spark, sf_dir, "documents"))).select(*rules.COLUMNS)


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7's ledger, stored once, tells of each rule of the default policy."""
    return rules.ablations(settle(rules.ledger(load(spark, sf_dir, "documents"))))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "copies", "n_links", "kept")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.LanguageModel.learn(langid.training_rows(docs.filter(hash_part("doc_id", 3) != 1)))
    found = langid.predict(docs, model)
    return found.select("doc_id", (hash_part("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed_digests(load(spark, sf_dir, "documents"), passage=PASSAGE)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_packing, op2_url_filter, op3_token_counts, op4_quality, op5_media, op6_bpe, op7_quality_rules, quality_rule_ablations, op8_near_duplicates, op9_language, op10_repeats)}


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": rules.ORACLE, "quality_rule_ablations": rules.ABLATIONS_ORACLE}
