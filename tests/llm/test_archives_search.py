"""Archives, ranked search and source divergence: against their SQL on odd rows, and their own interfaces."""

import gzip
import hashlib
import io
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotfield.llm import lexical_search, source_divergence, warc
from plotfield.llm.common import shared_folder

EXTRA = ["n", "doc", "term", "rank", "score", "body", "digest", "h", "k", "data", "p", "q", "total", "width", "item", "lead"]


def words(pick, n, vocabulary=60):
    return " ".join(pick.choice(["w", "Ärger", "été", "x9y", "W"]) + "abcdefghij"[pick.randrange(10)] * pick.randrange(1, 1 + vocabulary // 10) for _ in range(n))


def clashing(df):
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(EXTRA) if c not in df.columns])


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    want = con.sql(sql)
    got = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
    return got


# Archives

@pytest.fixture
def folder(spark, tmp_path):
    return f"{shared_folder(spark)}/{tmp_path.name}"


@pytest.mark.parametrize("chunk, file_bytes", [(warc.CHUNK_BYTES, warc.FILE_BYTES), (700, 2000)])
def test_archives_against_sql(spark, folder, chunk, file_bytes):
    pick = random.Random(3)
    large = [words(pick, 400) for _ in range(6)]
    html = [None, "", "é" * 999, "é" * 500, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "\r\n\r\nWARC/1.1\r\n" * 200, words(pick, 60_000)]
    html += [pick.choice(large) for _ in range(30)]
    rows = [(k, f"http://site/{k} a\r\né" if k % 3 else None, h) for k, h in enumerate(html)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    archives = warc.write_archives(df, folder, chunk=chunk, file_bytes=file_bytes)
    got = same(warc.records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), warc.SQL,
               pages=pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"html": "string"}))
    assert len(got) == len(rows) and archives.agg(F.sum("records")).first()[0] == len(rows)
    assert warc.records(archives).where("not intact").isEmpty()
    chunks = warc.read_chunks(archives, chunk).where("record_type = 'response'").collect()
    assert max(len(r.data) for r in chunks) <= chunk
    wholes = {}
    for r in sorted(chunks, key=lambda r: (r.record_id, r.chunk_no)):
        wholes[r.record_id] = wholes.get(r.record_id, b"") + bytes(r.data)
        # Each row carries the length and the digest up to it.
        assert (r.payload_bytes, r.payload_digest) == (len(wholes[r.record_id]), hashlib.sha1(wholes[r.record_id]).hexdigest())
    assert wholes["urn:page:9"] == html[9].encode() and wholes["urn:page:0"] == wholes["urn:page:1"] == b""


def test_archive_of_repeated_and_missing_keys(spark, folder):
    body = "z" * 2000
    rows = [("a b", body), ("a b", body), (None, body), ("A", body), (None, "q" * 1500), (None, "q" * 1500), ("a b", "other")]
    got = warc.records(warc.write_archives(spark.createDataFrame(rows, "name string, html string").withColumn("url", F.lit("u")), folder, key="name"), "name", "string")
    assert sorted((r.name or "", r.payload_bytes, r.record_type, r.refers_to or "") for r in got.collect()) == sorted([
        ("a b", 2000, "response", ""), ("a b", 2000, "response", ""), ("", 2000, "revisit", "a b"), ("A", 2000, "revisit", "a b"),
        ("", 1500, "response", ""), ("", 1500, "response", ""), ("a b", 5, "response", "")])


def test_archive_of_no_pages(spark, folder):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.write_archives(df, folder)
    assert archives.count() == 0 and warc.records(archives).count() == 0


def test_foreign_archive():
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>\r\n\r\n</p>"
    plain = (b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
             b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:r>\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: " + str(len(body)).encode()
             + b"\r\n\r\n" + body + b"\r\n\r\nWARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:s>\r\nContent-Length: 0\r\nWARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\n\r\n\r\n\r\n")
    for raw in (plain, gzip.compress(plain[:80]) + gzip.compress(plain[80:])):
        rows = list(warc.read_records(warc.Unpacked(io.BytesIO(raw), 7), 4))
        assert [(r[0], r[1], r[4], r[5], r[8], r[9]) for r in rows] == [
            ("urn:r", "response", 0, b"<p>\r", False, None), ("urn:r", "response", 1, b"\n\r\n<", False, None), ("urn:r", "response", 2, b"/p>", True, True), ("urn:s", "resource", 0, b"", True, False)]
        with pytest.raises(ValueError):
            list(warc.read_records(warc.Unpacked(io.BytesIO(raw[:-60]), 7), 4))


# Ranked search

def search_rows(pick):
    docs = [words(pick, pick.randrange(1, 80)) for _ in range(150)]
    docs += [docs[0]] * 40 + ["", None, "!!! ---", "Wa WA wa", words(pick, 30_000, 200)]
    return [(1000 - k, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("batch_terms", [lexical_search.BATCH_TERMS, 400])
def test_search_against_sql(spark, batch_terms):
    pick = random.Random(5)
    rows = search_rows(pick)
    items = [(k, words(pick, pick.randrange(1, 40))) for k in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (23, rows[0][1]), (24, "wa wa WA"), (25, rows[-1][1])]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = lexical_search.search(df, clashing(spark.createDataFrame(items, "item_id long, text string")), batch_terms=batch_terms)
    found = same(got, lexical_search.SQL, documents=pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"text": "string"}),
                 benchmark=pd.DataFrame(items, columns=["item_id", "text"]).astype({"text": "string"}))
    assert {r[0] for r in found} == {*range(12), 23, 24, 25}


def test_search_in_crowded_sketches(spark):
    """With four coordinates bounds are far too high; the results are the same, after several rounds of exact scores."""
    pick = random.Random(6)
    docs = spark.createDataFrame(search_rows(pick), "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(k, words(pick, 12)) for k in range(8)], "item_id long, text string")
    want, crowded = ({tuple(r) for r in lexical_search.search(docs, items, top=5, bits=b).collect()} for b in (lexical_search.BITS, 2))
    assert crowded == want and len(want) == 40


def test_search_of_odd_rows(spark):
    schema = "doc_id string, text string"
    rows = [("a", "one two"), ("a", "one"), ("a", "one two"), (None, "one"), ("b", "three"), ("c", None), ("d", "two")]
    items = spark.createDataFrame([(1, "one"), (1, "two"), (None, "one"), (2, "nine")], "item_id int, text string")
    got = [tuple(r) for r in lexical_search.search(spark.createDataFrame(rows, schema), items).orderBy("rank").collect()]
    # Six documents with eight terms; "one" in four, "two" in three; the first row of "a" has both.
    weight = {"one": int(1000 * np.log(14 / 9)), "two": int(1000 * np.log(14 / 7))}
    impact = lambda n: 10 ** 9 // (1000 + 12 * (75 + 25 * n * 6 // 8))
    assert got == [(1, 1, "a", (weight["one"] + weight["two"]) * impact(2)), (1, 2, "d", weight["two"] * impact(1))]
    empty = spark.createDataFrame([], schema)
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(spark.createDataFrame(rows, schema), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


# Divergence of sources

def divergence_rows(pick):
    rows = [(words(pick, pick.randrange(1, 60)), pick.choice(["en", "de", "", None]), pick.choice(["s0"] * 5 + ["s1", "ü2", "S3", "", None])) for _ in range(400)]
    return rows + [(None, "en", "quiet"), ("", "fr", "s0"), ("été", "fr", "s1"), ("one 1 two", "fr", None), ("lonely", "xx", "only")] + [(rows[0][0], "en", "copies")] * 30


@pytest.mark.parametrize("tile, block", [(source_divergence.TILE, source_divergence.BLOCK), (2, 3)])
def test_divergence_against_sql(spark, tile, block):
    rows = divergence_rows(random.Random(9))
    df = clashing(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4))
    got = same(source_divergence.source_divergence(df, tile=tile, block=block), source_divergence.SQL,
               documents=pd.DataFrame(rows, columns=["text", "lang", "source"]).astype("string"))
    assert ("fr", "s0", "pair", "", 0, 1) in got and any(r[1] == "quiet" for r in got) and not any(r[0] == "xx" for r in got)
    assert source_divergence.source_divergence(df.limit(0)).count() == 0


def test_run_columns_cover_their_counts(spark):
    pick = random.Random(1)
    docs = spark.createDataFrame(divergence_rows(pick), "text string, lang string, source string").fillna("")
    kept = source_divergence.kept_counts(docs, 10)
    runs = source_divergence.run_columns(kept, block=7)
    want = {(r.lang, r.source): r.n for r in kept.groupBy("lang", "source").agg(F.sum("n").alias("n")).collect()}
    assert {(r.lang, r.source): r.n for r in runs.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("length")).alias("n")).collect()} == want
    terms = {r.lang: r.n for r in kept.where("lead").groupBy("lang").count().withColumnRenamed("count", "n").collect()}
    assert {r.lang: r.n for r in runs.select("lang", "block", "width").distinct().groupBy("lang").agg(F.sum("width").alias("n")).collect()} == terms
    assert runs.count() < kept.count() and runs.where("start + length > width or width > 7").isEmpty()
