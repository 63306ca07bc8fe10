"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, language, paragraph_dedup, quality, secrets, suffix_dedup, surrogates, token_files
from tessera.llm.common import new_path, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: A passage of 50 words in other text has about 38 of them, its first and last ones not, in whole units.
REPEATED_WORDS = 30
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False)


def op2_jaccard_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), "base_sha256", F.col("span_list").alias("spans"), count("random").alias("n_random"))


def op5_token_files_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, VOCABULARY)
    return token_files.layout(spark, path)


def op4_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("enough")).alias("kept"), "score")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.replace(table(spark, sf_dir, "documents"), key="a key of the installation's own")
    count = lambda kind: F.coalesce(F.element_at("kinds", kind), F.lit(0)).cast("long")
    return found.select("doc_id", "n_entities", *(count(k).alias(f"n_{k}") for k in surrogates.TYPES), "text")


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.dedup(table(spark, sf_dir, "documents"), least_words=REPEATED_WORDS)


def op8_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4


def op9_language_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = language.learn(docs, fold() != 2)
    held = language.identify(docs, labelled).withColumn("held_out", F.coalesce(fold() == 2, F.lit(False)))
    return held.select("doc_id", "held_out", "lang_pred", "score")


def op10_suffix_bucket_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe_pair_index, op2_jaccard_prefix_join, op3_secret_scan, op4_quality_ratio, op5_token_files_orc, op6_pii_surrogates, op7_paragraph_minhash, op8_bm25_decontamination, op9_language_cross_parsing, op10_suffix_bucket_pointer)}
ORACLE: dict[str, str] = {}
