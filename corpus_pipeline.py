"""A corpus pipeline: from ``documents`` to token ids.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All stages but the last return the columns of ``documents`` and work on all that the one
before kept.

1. Language ID by cross-parsing entropy: documents in no learned language go: ``und``, or more bits a character than held-out
   labelled documents of the language allow. Learned from the labelled documents of the input.
2. N-gram Jaccard join, five words and 0.8: of each group of near and exact copies the document with the least doc_id stays. Rows
   that share a doc_id but not their text are documents of their own; rows equal in both are one, which stays or goes.
3. Benchmark decontamination: documents with a test item in them go.
4. Secret scan: secrets are masked.
5. BPE encoding: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids.

Documents with a null doc_id take part in all but the second stage, which passes them on; null texts go in the first.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, language, secrets
from tessera.llm.common import table, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    limit = language.limits(docs, held_out, language.learn(docs, ~held_out))
    return language.accepted(docs, language.learn(docs, F.lit(True)), limit)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows that share a doc_id may differ in text: a row is known by both
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("row_key")
    keyed = docs.select("doc_id", "text", row)
    groups = jaccard_join.join(keyed, n=5, percent=80, id_col="row_key").filter("doc_id is not null").select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("component")).distinct()
    named = keyed.filter("doc_id is not null").select("doc_id", "row_key").distinct().join(groups, "row_key")
    place = F.struct("doc_id", "row_key")
    kept = named.groupBy("component").agg(F.min(place).alias("kept"), F.count("*").alias("held")).filter("held > 1")
    gone = named.join(kept, "component").filter(place != F.col("kept")).select(F.col("doc_id").alias("gone_id"), "row_key").distinct()
    matches = (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == gone["row_key"])
    return docs.join(gone, matches, "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs, RANKS, public_tokenizers.PATTERN)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, VOCABULARY)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scan", secret_scan),
    ("BPE encoding", bpe_encoding),
]
#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
