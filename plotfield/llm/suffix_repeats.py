"""Repeated strings by interval trees over an enhanced suffix array.

All texts together are one string whose sorted suffixes, with the common prefixes of neighbours, form a tree of
common-prefix intervals. An interval whose suffixes can be extended to the left in different ways is a maximal repeat,
and all its suffixes are its occurrences. Only repeats of ``length`` bytes or more matter, so the array is kept sparse
and in shards: every window of ``length`` bytes is anchored at the smallest hash among its short substrings, equal
windows have equal anchors, and the suffixes that start at equal anchors are one shard of the array. A shard holds the
bytes around its anchors that the windows reach; there the intervals are found by a stack scan, and within each interval
the left extensions are compared. A shard with very many suffixes is split further by its windows' own hashes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import BASE, BASE_INVERSE, mixed, powers, settle, slices, small_side, text_bytes

LENGTH = 200
#: Bytes of an anchor. Windows of 200 bytes have 129 places for it.
ANCHOR = 72
#: Suffixes of a shard that one task holds at most; larger shards are split by window.
SHARD = 100_000


def anchored_windows(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: (hash, row, anchor place, first window, last window), places within rows."""
    empty = tuple(np.empty(0, np.int64) for _ in range(5))
    if len(data) < length:
        return empty
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    n = len(data) - anchor + 1
    hashes = mixed((sums[anchor:] - sums[:n]) * powers(BASE_INVERSE, n))
    bits = np.uint64(32)  # the same for all slices, so that the choice depends on the window's bytes alone
    key = (hashes >> bits << bits) | np.arange(n, dtype=np.uint64)
    width, step = length - anchor + 1, 1
    while step * 2 <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if width > step:
        key = np.minimum(key[: len(key) - (width - step)], key[width - step:])
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    valid = np.arange(len(place)) + length <= offsets[row + 1]
    windows = np.flatnonzero(valid)
    if not len(windows):
        return empty
    new = np.ones(len(windows), bool)
    new[1:] = (np.diff(place[windows]) != 0) | (np.diff(windows) != 1)
    first = windows[new]
    last = np.append(windows[np.flatnonzero(new)[1:] - 1], windows[-1])
    own = row[first]
    return hashes[place[first]].view(np.int64), own, place[first] - offsets[own], first - offsets[own], last - offsets[own]


def anchors(df: DataFrame, length: int, anchor: int) -> DataFrame:
    """(h, doc, at, low, high) of every run of windows of (doc, text): anchor hash, place, first and last window."""
    schema = StructType([StructField("h", LongType()), StructField("doc", df.schema["doc"].dataType),
                         *[StructField(n, IntegerType()) for n in ("at", "low", "high")]])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, row, at, low, high = anchored_windows(*text_bytes(part.column(1)), length, anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), part.column(0).take(pa.array(row)), *[pa.array(x.astype(np.int32)) for x in (at, low, high)]],
                    names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def common_prefix(x: bytes, y: bytes) -> int:
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(depth, first, last) of all common-prefix intervals; ``lcp[k]`` is the common prefix of suffixes k - 1 and k."""
    found, stack = [], [(0, 0)]
    for k in range(1, len(lcp) + 1):
        depth, first = (lcp[k] if k < len(lcp) else -1), k - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            if top > 0:
                found.append((top, first, k - 1))
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))
    return found


def shard_repeats(lefts: list[bytes], rights: list[bytes], length: int):
    """(left length, right length, members) of the maximal repeats of ``length`` or more in a shard.

    ``lefts`` are the reversed bytes before the anchors, ``rights`` the bytes from there on. An interval of depth r needs
    length - r common bytes to the left. Those of its suffixes that have them in common are again sorted, by left
    bytes, and scanned: each interval of left extensions whose members lie in different children of the right
    interval can be extended neither way.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    ordered = [rights[k] for k in order]
    lcp = [0, *(common_prefix(a, b) for a, b in zip(ordered, ordered[1:]))]
    # Suffixes that are equal to the end of what is held stay one interval of that depth.
    for depth, first, last in intervals(lcp):
        need = max(length - depth, 0)
        ranks = [k for k in range(first, last + 1) if len(lefts[order[k]]) >= need]
        if len(ranks) < 2:
            continue
        ranks.sort(key=lambda k: lefts[order[k]])
        cuts = [k for k in range(first + 1, last + 1) if lcp[k] == depth]  # where one child ends and the next begins
        texts = [lefts[order[k]] for k in ranks]
        left = [0, *(common_prefix(a, b) for a, b in zip(texts, texts[1:]))]
        if need == 0 and any(x == 0 for x in left[1:]):
            groups = [(0, 0, len(ranks) - 1), *intervals(left)]
        else:
            groups = intervals(left)
        for extension, low, high in groups:
            if extension < need:
                continue
            members = sorted(ranks[low: high + 1])
            cut = bisect_right(cuts, members[0])
            if cut < len(cuts) and cuts[cut] <= members[-1]:
                yield extension, depth, [order[k] for k in members]


def _groups(batches):
    """The rows of sorted batches, one list of slices of equal ``h`` at a time."""
    held, value = [], None
    for batch in batches:
        h = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if value is not None and h[a] != value:
                yield held
                held = []
            value = h[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def maximal_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """(repeat, bytes, key, start): the occurrences of all maximal repeats of at least ``length`` bytes of UTF-8.

    ``repeat`` names a group of equal strings, ``bytes`` is their length, ``start`` the place of the occurrence. What
    lies beyond the windows around an anchor is not held in its shard, so a longer repeat comes as a chain of
    overlapping groups, which together cover just its bytes. In a shard of over ``shard`` suffixes the groups are
    single windows. Repeats may overlap and may lie in one text; they never cross texts. Null and short texts
    have none. Keys must differ and not be null; other columns are not read. An empty table gives none.
    """
    rows = df.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")).where("doc is not null and text is not null")
    found = settle(anchors(rows, length, anchor))
    counts = settle(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    repeated = found.join(counts, "h")
    places = repeated.groupBy("doc").agg(F.collect_list(F.struct("h", "at", "low", "high", (F.col("n") > shard).alias("many"))).alias("places"))
    places = settle(places)
    texts = rows.join(small_side(places.select("doc")), "doc", "left_semi")
    fields = [("h", LongType()), ("doc", df.schema[key].dataType), ("at", IntegerType()), ("many", "boolean"), ("left", BinaryType()), ("right", BinaryType())]

    def around(batches):
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                out: list[list] = [[], [], [], [], [], []]
                for doc, whole, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = whole.encode()
                    for p in own:
                        at, low, high = p["at"], p["low"], p["high"]
                        for to, x in zip(out, (p["h"], doc, at, p["many"], data[low:at][::-1], data[at: high + length])):
                            to.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], part.column(0).type), pa.array(out[2], pa.int32()), pa.array(out[3], pa.bool_()),
                     pa.array(out[4], pa.binary()), pa.array(out[5], pa.binary())], names=[n for n, _ in fields])

    schema = ", ".join(f"`{n}` {t if isinstance(t, str) else t.simpleString()}" for n, t in fields)
    suffixes = texts.join(places, "doc").select("doc", "text", "places").mapInArrow(around, schema)
    crowded = counts.where(F.col("n") > shard)
    if not crowded.isEmpty():
        suffixes = settle(suffixes)
    few = suffixes.where("not many").repartition("h").sortWithinPartitions("h").select("h", "doc", "at", "left", "right")
    result = StructType([StructField("repeat", BinaryType()), StructField("bytes", IntegerType()), StructField("doc", df.schema[key].dataType), StructField("start", IntegerType())])

    def scan(batches):
        out: list[list] = [[], [], [], []]

        def full():
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], kind), pa.array(out[3], pa.int32())], names=result.names)
            for x in out:
                x.clear()
            return made

        kind = None
        for group in _groups(batches):
            kind = group[0].column(1).type
            docs, ats, lefts, rights = ([x for part in group for x in part.column(k).to_pylist()] for k in range(1, 5))
            for extension, depth, members in shard_repeats(lefts, rights, length):
                one = members[0]
                name = hashlib.blake2b(lefts[one][:extension][::-1] + rights[one][:depth], digest_size=16).digest()
                for k in members:
                    out[0].append(name)
                    out[1].append(extension + depth)
                    out[2].append(docs[k])
                    out[3].append(ats[k] - extension)
            if len(out[0]) > 20_000:
                yield full()
        if out[0]:
            yield full()

    repeats = few.mapInArrow(scan, result)
    if not crowded.isEmpty():
        repeats = repeats.unionByName(_single_windows(suffixes.where("many"), length, result))
    return repeats.withColumnRenamed("doc", key)


def _single_windows(suffixes: DataFrame, length: int, result: StructType) -> DataFrame:
    """Groups of equal windows of very large shards, by aggregation of the windows' digests."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                names, docs, places = [], [], []
                for k, (at, left, right) in enumerate(zip(part.column(2).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist())):
                    whole = left[::-1] + right
                    for p in range(len(whole) - length + 1):
                        names.append(hashlib.blake2b(whole[p: p + length], digest_size=16).digest())
                        docs.append(k)
                        places.append(at - len(left) + p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(np.full(len(names), length, np.int32)), part.column(1).take(pa.array(docs, pa.int64())),
                     pa.array(places, pa.int32())], names=result.names)

    windows = suffixes.select("h", "doc", "at", "many", "left", "right").mapInArrow(run, result)
    # Written first, so that the join reads no aggregation and a frequent window can be split.
    twice = small_side(settle(windows.groupBy("repeat").count().where("count > 1").drop("count")))
    return windows.join(twice, "repeat", "left_semi").select(*result.names)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): what is left of each text as bytes, once every byte that a repeated
    string of ``length`` bytes covers is gone.

    A null text counts as empty. Keys must differ; rows with a null key are dropped. Texts with an exact copy of ``length`` bytes or more are gone as a whole, and one of them
    stands for all in the search. Other columns are not read; an empty table gives an empty result.
    """
    rows = df.select(F.col(f"`{key}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("doc is not null")
    hashed = rows.where(F.octet_length("text") >= length).select("doc", F.unhex(F.sha2("text", 256)).alias("h"))
    copies = settle(hashed.groupBy("h").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"))
    members = settle(hashed.join(copies, "h").select("doc", (F.col("doc") == F.col("first")).alias("stands")))
    others = small_side(settle(members.where("not stands").select("doc")))
    single = rows.join(others, "doc", "left_anti")
    spans = maximal_repeats(single, "doc", "text", length).select("doc", "start", (F.col("start") + F.col("bytes")).alias("end"))
    spans = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = settle(spans.join(members.select("doc"), "doc", "left_anti"))
    touched = small_side(settle(spans.select("doc")))
    whole = small_side(settle(members.select("doc")))
    size = F.octet_length("text").cast("long")
    zero, nothing = F.lit(0).cast("long"), F.lit(b"")
    gone = rows.join(whole, "doc", "left_semi").select("doc", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), nothing.alias("kept"))
    intact = rows.join(whole, "doc", "left_anti").join(touched, "doc", "left_anti").select(
        "doc", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    schema = StructType([StructField("doc", df.schema[key].dataType), *[StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")], StructField("kept", BinaryType())])

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[], [], [], []]
                for raw, own in zip(part.column(1).to_pylist(), part.column(2)):
                    data = raw.encode()
                    pairs = own.values.flatten()
                    edge = np.bincount(pairs[0].to_numpy(), minlength=len(data) + 1) - np.bincount(pairs[1].to_numpy(), minlength=len(data) + 1)
                    covered = np.cumsum(edge)[:-1] > 0
                    out[0].append(len(data))
                    out[1].append(int(covered.sum()))
                    out[2].append(int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum()))
                    out[3].append(np.frombuffer(data, np.uint8)[~covered].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.binary())], names=schema.names)

    some = rows.join(touched, "doc", "left_semi").join(spans, "doc").select("doc", "text", "spans").mapInArrow(cut, schema)
    return gone.unionByName(intact).unionByName(some).withColumnRenamed("doc", key)
