"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from plotfield.llm import byte_bpe, decontaminate, html_extract, line_dedup, ngram_quality, order_minhash, paragraph_dedup, quality_rules, suffix_repeats, token_attribution
from plotfield.llm.queries import ORACLES, QUERIES

LONG = " ".join(f"word{k % 5000} of the {k}" for k in range(40_000))
TEXT = " ".join(f"the {k} of a kind" for k in range(40))
ROWS = [(1, TEXT, "en", "s1", 5), (2, None, "en", "s1", None), (3, "", None, None, 0), (4, LONG, "en", "s2", 1), (5, TEXT, None, "s3", 5), (6, TEXT, "en", "s1", 5), (6, TEXT, "en", "s1", 5),
        (7, " \n\t ", "de", "s1", 3), (None, TEXT, "en", "s1", 5), (8, "\n".join([TEXT] * 3), "en", None, 9), (9, "!!!", "en", "s1", 3)]
CLASHES = ["doc", "at", "h", "p", "a", "b", "root", "node", "key", "n", "line", "words", "k", "m", "value", "band", "count", "spans", "item", "found", "kept", "places"]


@pytest.fixture
def documents(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "nothing of this is in any of those texts"), (2, None), (3, ""), (None, "x")], "item_id long, text string")


OPERATORS = {
    "extract": (lambda d, b, q: html_extract.extract_text(d.withColumnRenamed("text", "html")), 11),
    "rules": (lambda d, b, q: quality_rules.judged(d), 11),
    "suffix": (lambda d, b, q: suffix_repeats.remove_repeats(d), 10),
    "benchmark": (lambda d, b, q: decontaminate.decontaminate(d, b), 11),
    "lines": (lambda d, b, q: line_dedup.line_dedup(d), 11),
    "ngram": (lambda d, b, q: ngram_quality.classified(d.where("doc_id <> 6"), q), 8),
    "near": (lambda d, b, q: order_minhash.near_duplicates(d), 9),
    "one": (lambda d, b, q: order_minhash.keep_one(d), None),
    "paragraphs": (lambda d, b, q: paragraph_dedup.paragraph_dedup(d), 10),
    "bpe": (lambda d, b, q: byte_bpe.bpe_digests(d), 11),
    "sections": (lambda d, b, q: token_attribution.section_tokens(d, "doc_id"), None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(documents, items, labels, name):
    operator, rows = OPERATORS[name]
    got = operator(documents, items, labels).collect()
    assert got and (rows is None or len(got) == rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(documents, items, labels, name):
    got = OPERATORS[name][0](documents.limit(0), items, labels)
    assert got.count() == 0 and got.columns


def test_copies_of_odd_rows(documents):
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(documents).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 1, 7: 7, 8: 8, 9: 9}


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, documents, items, tmp_path, empty):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents.limit(0) if empty else documents
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in docs.collect()} == (set() if empty else {1, None, 4} & {r.doc_id for r in docs.collect()})


def test_registration():
    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names and {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_pipeline_on_the_given_tables(spark):
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("test tables not mounted")
    got = corpus_pipeline.run(spark, str(data)).collect()
    assert 0 < len(got) < spark.read.parquet(str(data / "documents.parquet")).count()
    assert all(r.n_tokens > 0 for r in got)
