"""Benchmark decontamination by size-partitioned MinHash containment.

A short item inside a long document has a tiny Jaccard similarity with it, so MinHash of the whole document does not
find it; containment of the item does. Items are partitioned by size, each partition has its own number of minimum
hashes, and a document's side of a partition's sketch is all its shingle hashes below the partition's largest one
(a containment sketch). Items that share enough of their minimum hashes with a document are candidates, and a candidate
is verified by exact containment of word shingles, on the strings themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import let, letters_words, settle, small_side

SHINGLE = 5
THRESHOLD = 0.8
#: Minimum hashes of an item: all of small items, up to this many of items of each larger class.
FEW_HASHES, MORE_HASHES, LARGE_ITEM = 12, 16, 64
ALL = 2_000_000_000


def shingle_numbers(words: Column) -> Column:
    """64-bit hashes of the runs of five words, in text order, as an array; without elements for fewer words."""
    next_to = lambda x, k: F.slice(x, k + 1, ALL)

    def run(h: Column) -> Column:
        two = F.zip_with(h, next_to(h, 1), lambda a, b: F.xxhash64(a, b))
        return let(two, lambda t: F.slice(
            F.zip_with(F.zip_with(t, next_to(t, 2), lambda a, b: F.xxhash64(a, b)), next_to(h, 4), lambda a, b: F.xxhash64(a, b)),
            1, F.greatest(F.size(h) - (SHINGLE - 1), F.lit(0))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), run)


def shingle_strings(words: Column) -> Column:
    """The distinct runs of five words as strings."""
    return let(words, lambda w: F.array_distinct(F.when(F.size(w) >= SHINGLE, F.transform(
        F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))).otherwise(F.array().cast("array<string>"))))


def item_sketches(items: DataFrame) -> DataFrame:
    """(item, size_class, h, needed): the minimum hashes of each item of (item, n, h).

    The size class is the power of two below the item's number of distinct shingles. ``needed`` of the hashes must be
    found in a document: a quarter of what the threshold would give on average, so that true items are missed with
    a probability below one in a million, and one at least.
    """
    budget = F.when(F.col("n") < LARGE_ITEM, FEW_HASHES).otherwise(MORE_HASHES)
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("h"))).where(F.col("rank") <= budget)
    held = F.least("n", budget)
    return ranked.select("item", F.floor(F.log2("n")).cast("int").alias("size_class"), "h",
                         F.greatest(F.lit(1), F.floor(held * F.lit(THRESHOLD / 4))).cast("int").alias("needed"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, item_key, n_shared, n_item): the items of which a document holds at least ``threshold`` of the shingles.

    Words are lower-case runs of letters and digits; shingles are five words. Texts are taken whole. Documents or
    items of fewer words, of no text or without a key match nothing. Repeated keys are treated as one document, or one
    item, that holds the shingles of all its rows. Each pair comes once; an empty table on either side gives none;
    other columns are not read.
    """
    read = lambda df, k, t: df.select(F.col(f"`{k}`").alias("key"), letters_words(F.col(f"`{t}`")).alias("words")).where("key is not null")
    own = read(items, item_key, item_text)
    strings = settle(own.select(F.col("key").alias("item"), F.explode(shingle_strings(F.col("words"))).alias("shingle")).distinct())
    sizes = strings.groupBy("item").agg(F.count("*").alias("n"))
    hashed = (own.select(F.col("key").alias("item"), F.explode(shingle_numbers(F.col("words"))).alias("h")).distinct()
              .join(sizes, "item"))
    sketches = settle(item_sketches(hashed))
    reach = sketches.groupBy().agg(F.max("h")).first()[0]
    texts = read(docs, key, text)
    in_reach = F.filter(shingle_numbers(F.col("words")), lambda h: h <= F.lit(reach).cast("long"))
    hits = texts.select(F.col("key").alias("doc"), F.explode(in_reach).alias("h")).join(small_side(sketches), "h")
    candidates = settle(hits.groupBy("doc", "item", "size_class").agg(F.count_distinct("h").alias("found"), F.max("needed").alias("needed"))
                        .where(F.col("found") >= F.col("needed")).select("doc", "item").distinct())
    suspects = small_side(settle(candidates.select("doc").distinct()))
    held = (texts.withColumnRenamed("key", "doc").join(suspects, "doc", "left_semi")
            .select("doc", F.explode(shingle_strings(F.col("words"))).alias("shingle")))
    matched = (held.join(small_side(strings), "shingle").select("doc", "item", "shingle")
               .join(small_side(candidates), ["doc", "item"], "left_semi")
               .groupBy("doc", "item").agg(F.count_distinct("shingle").alias("n_shared")))
    return (matched.join(sizes, "item").where(F.col("n_shared") >= F.lit(threshold) * F.col("n"))
            .select(F.col("doc").alias(key), F.col("item").alias(item_key), "n_shared", F.col("n").alias("n_item")))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", **named) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; rows with a null key stay."""
    found = contaminated(docs, items, key, **named).select(F.col(key).alias("__found")).distinct()
    return docs.join(small_side(settle(found)), F.col(f"`{key}`") == F.col("__found"), "left_anti")


#: The pairs by exact containment alone, over tables ``documents`` and ``benchmark``.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5
), bs AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) >= 5
), n AS (
  SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id
)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)
"""
