"""A corpus from raw documents to token ids, in five stages.

Each stage works on all that the one before it kept, and its result is written before the next one reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotfield.llm import byte_bpe, decontaminate, line_dedup, order_minhash, quality_rules
from plotfield.llm.common import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table; the others go."""
    return quality_rules.quality_rules(docs).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines. One whose lines were all boilerplate goes: each of them still
    stands where it occurred first."""
    cleaned = line_dedup.line_dedup(docs)
    return (cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
            .withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id."""
    return order_minhash.keep_one(docs).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return byte_bpe.bpe_digests(docs).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("order_minhash", near_duplicates),
          ("decontaminate", benchmark), ("byte_bpe", encoding)]

#: SQL has neither the sketches of the third stage nor the merges of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
