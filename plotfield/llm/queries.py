"""The corpus operators as registered queries, with their SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (byte_bpe, decontaminate, html_extract, lexical_search, line_dedup, ngram_quality, order_minhash, paragraph_dedup,
               quality_rules, source_divergence, suffix_repeats, token_attribution, warc)
from .common import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query()
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the quality rules for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept")


@query()
def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of repeated strings of 200 bytes."""
    left = suffix_repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(decontaminate.SQL)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(line_dedup.SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites carry."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_removed")


@query()
def op6_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict for every document, from a model of all trusted ones."""
    return ngram_quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs that repeat an earlier one."""
    return paragraph_dedup.paragraph_dedup(table(spark, sf_dir, "documents"))


@query()
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes decoded from them."""
    return byte_bpe.bpe_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op10_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole text."""
    return token_attribution.section_tokens(table(spark, sf_dir, "documents"), "doc_id")


@query(warc.SQL)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to archives and read back."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    return warc.records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(lexical_search.SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(source_divergence.SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set each source apart."""
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))
