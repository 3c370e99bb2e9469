"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space as the word contracts count it: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; its own one only where that is
    unset, as in tests on one machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
        found = context.getCheckpointDir()
    return found


def settle(df: DataFrame) -> DataFrame:
    """Write a table that later steps read several times, and go on from the written copy: it outlives
    lost executors, and its size is known to the optimizer."""
    path = f"{shared_folder(df.sparkSession)}/corpus-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table with a broadcast hint if it has at most ``rows`` rows; else as it is, and the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row, also where ``body`` is a lambda's inside."""
    return F.transform(F.array(value), body)[0]


def letters_words(text: Column) -> Column:
    """Lower-case words: the runs of letters and digits. A null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a table of links: (node, root), root the smallest node of each component.

    In a round every node goes to its smallest neighbour, if that is smaller, and from there on to where that one goes, by jumps that double until none
    leads further; links then join what their ends have gone to. The links between different nodes become fewer by a large part
    with every round. All steps are joins and aggregations with map-side combination whose results are
    written. A link of a node with itself is allowed; null ends are dropped.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    ends = settle(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ends, rounds = ends.where("u <> v"), []
    while not ends.isEmpty():
        gone = settle(ends.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")))
        while True:
            # Where a node's root goes on from there, if it does.
            onward = gone.select(F.col("node").alias("root"), F.col("root").alias("further"))
            new = settle(gone.join(onward, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
            gone = new.select("node", "root")
            if new.where("moved").isEmpty():
                break
        rounds.append(gone)
        u, v = (gone.select(F.col("node").alias(k), F.col("root").alias(f"{k}r")) for k in "uv")
        met = ends.join(v, "v").join(u, "u", "left").select(F.coalesce("ur", "u").alias("u"), F.col("vr").alias("v")).where("u <> v")
        ends = settle(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    # The roots of a round are nodes of the next one, or stay.
    found = None
    for gone in reversed(rounds):
        if found is not None:
            onward = found.select(F.col("node").alias("root"), F.col("root").alias("further"))
            gone = gone.join(onward, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
            gone = settle(gone.unionByName(found))
        found = gone
    if found is None:
        return settle(nodes.withColumn("root", F.col("node")))
    return settle(nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES):
    """A batch in slices of about ``size`` bytes of its text column, one row at least."""
    texts = batch.column(batch.schema.get_field_index(column))
    width = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    ends = np.cumsum(width)
    start = 0
    while start < len(width):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array, nulls as empty, and the offsets of its rows."""
    texts = pc.fill_null(texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over an array of hashes."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of words: ASCII letters in lower case, digits, and all bytes of other characters; zero elsewhere.
WORD_BYTE = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0
                      for b in range(256)], np.uint8)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


#: Powers that a task keeps for its next slices, by base, and how many at most.
_POWERS: dict[int, np.ndarray] = {}
_KEPT = 4_000_000


def powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, min(2 * n, _KEPT)), base, np.uint64)
        known[:1] = 1
        known = np.multiply.accumulate(known)
        known.flags.writeable = False
        if len(known) <= _KEPT:
            _POWERS[base] = known
    return known[:n]


#: Bytes whose words are hashed at a time, so that what is made of them stays in the processor's cache.
HASHED_BYTES = 250_000


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of many texts at once, with their first and end bytes, and the word offsets of the texts.

    A word is a run of ASCII letters or digits and of characters outside ASCII, or of the bytes that another ``table``
    maps to others than zero. Lower case is taken of ASCII letters.
    """
    none = np.empty(0, np.int64)
    found, texts, first = [(np.empty(0, np.uint64), none, none, none)], len(offsets) - 1, 0
    while first < texts:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + HASHED_BYTES, side="right")) - 1)
        base, known = offsets[first], sum(len(f[0]) for f in found)
        hashes, starts, ends, at = _word_hashes(data[base: offsets[stop]], offsets[first: stop + 1] - base, table)
        found.append((hashes, starts + base, ends + base, at[:-1] + known))
        first = stop
    hashes, starts, ends, at = (np.concatenate(x) for x in zip(*found))
    return hashes, starts, ends, np.append(at, len(hashes))


def _word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, bool)
    np.not_equal(table[data], 0, out=inside[1:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    sums = np.zeros(len(data) + 1, np.uint64)
    own = (table.astype(np.uint64) + np.uint64(1))[data]
    own *= powers(BASE, len(data))
    np.cumsum(own, out=sums[1:])
    back = powers(BASE_INVERSE, len(data))
    hashes = mixed((sums[ends] - sums[starts]) * back[starts]) if len(starts) else np.empty(0, np.uint64)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words that do not cross texts, and the offsets of the texts among them."""
    n = np.diff(offsets)
    counts = np.maximum(n - size + 1, 0)
    new = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(offsets[:-1] - new[:-1], counts) + np.arange(new[-1])
    found = np.zeros(new[-1], np.uint64)
    for k in range(size):
        found = mixed(found * np.uint64(31) + words[first + k])
    return found, new
