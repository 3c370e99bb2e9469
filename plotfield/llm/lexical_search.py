"""Ranked lexical search with hashed max-sketches.

A document's sketch holds, for each of 2 ** 20 hashed coordinates that its terms meet, the largest number of occurrences
of a term there; as a term's impact grows with its occurrences, these are the coordinatewise maxima of its impacts. A
batch of items is looked up in the sketches: the weighted sum of the maxima at an item's coordinates is at least the
document's score. Documents are then scored exactly in the order of falling bounds, until no bound reaches the
lowest score among an item's best.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import settle, slices, small_side, text_bytes, word_hashes

BITS = 20
TOP = 20
#: Terms of items that are looked up in one batch; more items make further batches.
BATCH_TERMS = 200_000
#: Documents whose bounds a task holds at a time, and the factor by which the rounds of exact scoring grow.
BLOCK, GROWTH = 1000, 4
#: A term: letters and digits of ASCII, and everything outside of ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents WHERE text IS NOT NULL),
     tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
     len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
     total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
     weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
     asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
               FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
     scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
                FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN len USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


def _terms(part: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a slice: row and hash of each distinct term of a row, its occurrences, and the terms of each row."""
    data, offsets = text_bytes(part.column(at))
    words, _, _, ends = word_hashes(data, offsets)
    sizes = np.diff(ends)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((words, rows))
    words, rows = words[order], rows[order]
    first = np.ones(len(words), bool)
    first[1:] = (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(first)
    return rows[starts], words[starts], np.diff(np.append(starts, len(words))), sizes


def _coordinates(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.int64)


def document_sketches(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc, n, coordinates, maxima) of (doc, text): the terms of each text, and its sketch. A null text has no term."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, words, counts, sizes = _terms(part, 1)
                cells = rows << bits | _coordinates(words, bits)
                order = np.argsort(cells, kind="stable")
                cells, counts = cells[order], counts[order]
                starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.empty(0, np.int64)
                cells, most = cells[starts], np.maximum.reduceat(counts, starts) if len(starts) else counts
                ends = np.searchsorted(cells, np.arange(len(sizes) + 1) << bits).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (cells & ((1 << bits) - 1), most)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), *lists], names=["doc", "n", "coordinates", "maxima"])

    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, n long, coordinates array<int>, maxima array<int>")


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term, times): the terms of each item; the texts of a repeated key count together, rows without a key or text not at all."""
    words = F.expr(rf"regexp_extract_all(translate(`{text}`, '{UPPER}', '{LOWER}'), r'({TERM})', 1)")
    return (items.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("item"), F.explode(words).alias("term"))
            .groupBy("item", "term").agg(F.count("*").alias("times")))


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What ``tf`` occurrences of a term count for in documents of ``n`` terms."""
    m = 75 + (25 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Batch:
    """A bounded number of items by their numbers: for each term, sorted by hash, its weight and the items that ask for it."""

    def __init__(self, asked: list[tuple[int, bytes, int]]):
        names = sorted({t for _, t, _ in asked})
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in names])]).astype(np.int64)
        hashes = word_hashes(np.frombuffer(b"\0".join([*names, b""]), np.uint8), offsets)[0]
        order = np.argsort(hashes)
        self.hashes, self.names = hashes[order], [names[k] for k in order]
        place = {t: k for k, t in enumerate(self.names)}
        asked = sorted((place[t], item, times) for item, t, times in asked)
        self.items = np.array([i for _, i, _ in asked], np.int64)
        self.times = np.array([t for _, _, t in asked], np.int64)
        self.owner = np.array([p for p, _, _ in asked], np.int64)
        self.ends = np.searchsorted(self.owner, np.arange(len(self.names) + 1))
        self.n = int(self.items.max()) + 1 if len(self.items) else 0

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The indices of the words that are terms of the batch, and their numbers."""
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == words)
        return hit, at[hit]

    def sums(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n_rows: int) -> np.ndarray:
        """The items' sums of weighted values (row, term, value), a row of the result for each row."""
        counts = self.ends[terms + 1] - self.ends[terms]
        at = np.repeat(self.ends[terms] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        out = np.zeros(n_rows * self.n, np.int64)
        np.add.at(out, np.repeat(rows, counts) * self.n + self.items[at], np.repeat(values, counts) * self.weights[at])
        return out.reshape(n_rows, self.n)

    def weigh(self, holding: dict[int, int], docs: int) -> None:
        """Set the weights of the items' terms, from the number of documents that hold each term."""
        own = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * holding.get(k, 0) + 1))) for k in range(len(self.names))], np.int64)
        self.weights = own[self.owner] * self.times


def holders(docs: DataFrame, batch: Batch) -> DataFrame:
    """(term, holding): the number of documents (doc, text) that hold each term of the batch."""
    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                counts = np.bincount(batch.find(_terms(part, 1)[1])[1], minlength=len(batch.hashes))
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "holding"])

    return docs.mapInArrow(run, "term long, holding long").groupBy("term").agg(F.sum("holding").alias("holding"))


def bounds(sketches: DataFrame, batch: Batch, docs: int, terms: int, least: np.ndarray | None = None, top: int = TOP,
           bits: int = BITS) -> DataFrame:
    """(item, doc, bound): upper bounds of scores. With ``least``, all those of at least an item's ``least``; without, of each
    block of documents the best ``top`` of every item."""
    # The coordinates of the batch's terms rise with their hashes.
    places = _coordinates(batch.hashes, bits)

    def run(batches):
        floor = np.ones(batch.n, np.int64) if least is None else np.maximum(least, 1)
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                # Documents by rising key, so that the first of equal bounds have the smallest keys.
                part = part.take(pc.sort_indices(part.column(0)))
                lists = part.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                rows = np.repeat(np.arange(len(sizes)), sizes)
                cells, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                low, high = np.searchsorted(places, cells), np.searchsorted(places, cells, side="right")
                met = np.flatnonzero(high > low)
                # A coordinate that several terms of the batch meet counts for each of them.
                counts = (high - low)[met]
                owner = np.repeat(met, counts)
                term = np.repeat(low[met] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                n = part.column(1).to_numpy()[rows[owner]]
                table = batch.sums(rows[owner], term, impacts(tf[owner], n, docs, terms), part.num_rows)
                if least is None:
                    best = np.argsort(-table, axis=0, kind="stable")[:top]
                    value = np.take_along_axis(table, best, 0)
                    keep = value >= floor
                    row, item, value = best[keep], np.broadcast_to(np.arange(batch.n), best.shape)[keep], value[keep]
                    if len(best) == top:
                        floor = np.maximum(floor, np.take_along_axis(table, best[-1:], 0)[0])
                else:
                    row, item = np.nonzero(table >= floor)
                    value = table[row, item]
                yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), part.column(0).take(pa.array(row)), pa.array(value)], names=["item", "doc", "bound"])

    return sketches.where("doc is not null").mapInArrow(run, f"item int, doc {sketches.schema['doc'].dataType.simpleString()}, bound long")


def scores(rows: DataFrame, pairs: DataFrame, batch: Batch, docs: int, terms: int) -> DataFrame:
    """(item, doc, score): exact scores of the pairs (item, doc), the best one of a repeated key."""
    wanted = small_side(settle(pairs.groupBy("doc").agg(F.collect_set("item").alias("items"))))

    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                row, words, tf, sizes = _terms(part, 1)
                hit, term = batch.find(words)
                row, tf = row[hit], tf[hit]
                table = batch.sums(row, term, impacts(tf, sizes[row], docs, terms), part.num_rows)
                lists = part.column(2)
                item = lists.flatten().to_numpy()
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(item), part.column(0).take(pa.array(owner)), pa.array(table[owner, item])], names=["item", "doc", "score"])

    found = rows.join(wanted, "doc").select("doc", "text", "items").mapInArrow(run, f"item int, doc {rows.schema['doc'].dataType.simpleString()}, score long")
    return found.groupBy("item", "doc").agg(F.max("score").alias("score"))


def best_of(df: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k`` rows (item, doc, value) of each item with the largest values, equal ones by rising doc, with their rank."""
    order = Window.partitionBy("item").orderBy(F.desc(value), "doc")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _batch_search(rows: DataFrame, sketches: DataFrame, batch: Batch, docs: int, terms: int, top: int, bits: int) -> DataFrame:
    """(item, doc, score, rank) for the items of one batch."""
    batch.weigh({r.term: r.holding for r in holders(rows, batch).collect()}, docs)
    kind = sketches.schema["doc"].dataType.simpleString()

    def last(best: DataFrame) -> DataFrame:
        """(item, low, low_doc): the row that a further one must beat."""
        return best.where(F.col("rank") == top).select("item", F.col("score").alias("low"), F.col("doc").alias("low_doc"))

    def unbeaten(pairs: DataFrame, best: DataFrame) -> DataFrame:
        return (pairs.join(F.broadcast(last(best)), "item", "left")
                .where("low is null or bound > low or bound = low and doc < low_doc").select("item", "doc", "bound"))

    tried = settle(best_of(bounds(sketches, batch, docs, terms, top=top, bits=bits).groupBy("item", "doc").agg(F.max("bound").alias("bound")), "bound", top))
    best = settle(best_of(scores(rows, tried, batch, docs, terms).where("score > 0"), "score", top))
    least = np.zeros(batch.n, np.int64)
    for r in last(best).collect():
        least[r.item] = r.low
    left = bounds(sketches, batch, docs, terms, least, top, bits).groupBy("item", "doc").agg(F.max("bound").alias("bound"))
    left = settle(unbeaten(left, best).join(tried.select("item", "doc"), ["item", "doc"], "left_anti"))
    k = top
    while not left.isEmpty():
        k *= GROWTH
        tried = settle(best_of(left, "bound", k).select("item", "doc"))
        more = scores(rows, tried, batch, docs, terms).where("score > 0")
        best = settle(best_of(best.select("item", "doc", "score").unionByName(more), "score", top))
        left = settle(unbeaten(left.join(tried, ["item", "doc"], "left_anti"), best))
    return best.select(F.col("item").cast("int").alias("item"), F.col("doc").cast(kind).alias("doc"), "score", "rank")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           top: int = TOP, batch_terms: int = BATCH_TERMS, bits: int = BITS) -> DataFrame:
    """(item_key, rank, key, score): the ``top`` documents of each item with the highest scores above 0, equal scores by rising key.

    Every row counts in the statistics of the corpus, a text without terms (null, empty) not as a document. A repeated
    key is ranked once, by the best of its texts; rows without a key are not ranked. The texts of a repeated item count as
    one. Items are looked up in batches of about ``batch_terms`` terms, whose postings go to the tasks; sketches of
    2 ** ``bits`` coordinates are written once. Terms are compared by 64-bit hashes. Other columns are not read; empty tables give no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    sketches = settle(document_sketches(rows, bits))
    total = sketches.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    asked = settle(item_terms(items, item_key, item_text))
    size = asked.count()
    item_kind = asked.schema["item"].dataType.simpleString()
    found = None
    n_batches = -(-size // batch_terms)
    for k in range(n_batches if total.docs else 0):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_batches)) == k).collect()
        if not own:
            continue
        names = sorted({r.item for r in own})
        number = {x: i for i, x in enumerate(names)}
        best = _batch_search(rows, sketches, Batch([(number[r.item], r.term.encode(), r.times) for r in own]), total.docs, total.terms, top, bits)
        ids = spark.createDataFrame(list(enumerate(names)), f"item int, name {item_kind}")
        part = best.join(F.broadcast(ids), "item").select(F.col("name").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = rows.schema["doc"].dataType.simpleString()
        found = spark.createDataFrame([], f"`{item_key}` {item_kind}, rank int, `{key}` {kind}, score long")
    return found
