"""Near-duplicate documents by Order MinHash and banded alignment.

Each 5-word shingle of a document is labelled with its occurrence number, each of a number of sketches takes the few smallest
labelled shingles under its own hash and keeps them in text order, so that two documents meet in a sketch if they share
shingles *and* their order: edit similarity, not set similarity. Documents that meet have their words aligned in a band around
the diagonal; two are linked if the common subsequence of their words is at least 0.8 of the words of both (common / (all of
a + all of b - common)).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, mixed, settle, shingle_hashes, slices, small_side, text_bytes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: Shingles in a sketch, and sketches. Where one word in twenty differs, 0.63 of the shingles are common and a sketch agrees with a chance
#: of about 0.63 ** 2: all 16 fail for one pair in about 4,000; where one in ten differs (similarity 0.8), for one in 20.
PICKED, SKETCHES = 2, 16
#: Members before it that a member of a sorted bucket may be compared with, the further sketches by which buckets are sorted, and
#: the distances between their bands, one for each order.
WIDTH, DEPTH, STRIDES = 8, 4, (1, 3)
#: Sketches that neighbours must share to be compared, the bucket's own among them. Where one word in twenty differs, a pair shares six
#: on average, and fewer than three in one case of 50.
AGREE = 3
#: Members of a bucket that are compared in one cell, pairs that a task looks at together, and bins for counts of words.
CELL, PAIRS, BINS = 2048, 500_000, 256
#: Pairs that are gone through in one step.
BLOCK = 20_000
#: Rows, or bytes of rows, of cells that a task gathers before it compares them.
ROWS_TOGETHER, BYTES_TOGETHER = 12_000, 8_000_000


def order_minhash(shingles: np.ndarray, offsets: np.ndarray, picked: int = PICKED, sketches: int = SKETCHES) -> np.ndarray:
    """Sketch values, one row a document: hashes of its ``picked`` smallest labelled shingles in text order.

    A document with fewer shingles is represented by all it has.
    """
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(shingles)
    out = np.zeros((len(counts), sketches), np.uint64)
    if not n:
        return out
    # Occurrence numbers: rank of a shingle among the equal ones of its document.
    own = mixed(shingles ^ mixed(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    ordered = own[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    label = np.empty(n, np.uint64)
    label[order] = (np.arange(n) - first).astype(np.uint64)
    keys = mixed(shingles + mixed(label))
    some = np.flatnonzero(counts)
    starts = offsets[some]
    largest = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(sketches):
        g = mixed(keys ^ mixed(np.array([j + 1], np.uint64)))
        at = np.full((len(counts), picked), n, np.int64)
        for p in range(picked):
            least = np.minimum.reduceat(g, starts)
            where = np.flatnonzero(g == np.repeat(least, counts[some]))
            owner, one = np.unique(doc[where], return_index=True)
            at[owner, p] = where[one]
            # A document without shingles left keeps the mark n; its used-up minimum is all ones.
            used = g[where[one]] == largest
            at[owner[used], p] = n
            g[where[one]] = largest
        at.sort(axis=1)
        value = np.full(len(counts), j + 1, np.uint64)
        padded = np.append(keys, np.uint64(0))
        for p in range(picked):
            value = mixed(value * np.uint64(31) + padded[at[:, p]])
        out[:, j] = value
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence, or -1 if it is below ``least``.

    A subsequence of ``least`` leaves at most len(a) - least elements of ``a`` and len(b) - least of ``b`` out, so
    matches lie in a band of that width around the diagonal. The rows of the band are numbers whose bits are cells.
    """
    if min(len(a), len(b)) < least:
        return -1
    head = 0
    m = min(len(a), len(b))
    same = np.flatnonzero(a[:m] != b[:m])
    head = int(same[0]) if len(same) else m
    a, b = a[head:], b[head:]
    m = min(len(a), len(b))
    same = np.flatnonzero(a[len(a) - m:][::-1] != b[len(b) - m:][::-1])
    tail = int(same[0]) if len(same) else m
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    found, least = head + tail, least - head - tail
    if min(len(a), len(b)) < least:
        return -1
    if not len(a) or not len(b):
        return found if least <= 0 else -1
    down, right = len(a) - max(least, 0), len(b) - max(least, 0)
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for i, x in enumerate(a.tolist()):
        low, high = max(0, i - down), min(len(b), i + right + 1)
        match = row & places.get(x, 0) & (((1 << max(0, high - low)) - 1) << low)
        if match:
            row = (row + match | row & ~match) & every
    found += len(b) - row.bit_count()
    return found if found >= least + head + tail else -1


def sequences(df: DataFrame, text: str) -> DataFrame:
    """(doc, words): 32-bit word hashes in text order, of (doc, text)."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column(1))
                words, _, _, at = word_hashes(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((words >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc", "words"])

    return df.mapInArrow(run, f"doc {df.schema['doc'].dataType.simpleString()}, words array<int>")


def document_sketches(df: DataFrame, picked: int = PICKED, sketches: int = SKETCHES) -> DataFrame:
    """(doc, n, band, value) for every sketch of the documents of (doc, text) that have a shingle; ``n`` counts the words."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column(1))
                words, _, _, at = word_hashes(data, offsets)
                shingles, ends = shingle_hashes(words, at, SHINGLE)
                rows = np.flatnonzero(np.diff(ends))
                values = order_minhash(shingles, ends, picked, sketches)[rows].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(rows, sketches))), pa.array(np.repeat(np.diff(at)[rows], sketches)), pa.array(np.tile(np.arange(sketches, dtype=np.int32), len(rows))),
                     pa.array(values.ravel())], names=["doc", "n", "band", "value"])

    return df.mapInArrow(run, f"doc {df.schema['doc'].dataType.simpleString()}, n bigint, band int, value bigint")


def verified(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of the rows (a, b, sa, sb) whose aligned words are similar enough."""
    def run(batches):
        for batch in batches:
            keep, scores = [], []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                need = int(np.ceil(threshold * (len(x) + len(y)) / (1 + threshold) - 1e-9))
                m = common_subsequence(x, y, need)
                if m >= need:
                    keep.append(k)
                    scores.append(m / (len(x) + len(y) - m))
            index = pa.array(np.array(keep, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(np.array(scores))], names=["a", "b", "similarity"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def star_pairs(members: DataFrame, order: Column) -> DataFrame:
    """Distinct (a, b): every member of a bucket of (band, value, doc, root, ...) with the bucket's centre, the first by ``order``,
    unless both are of one class. The number of pairs stays in proportion to the members."""
    centres = (members.groupBy("band", "value").agg(F.min(F.struct(order.alias("o"), "doc", "root")).alias("c"), F.count("*").alias("n"))
               .where("n > 1").select("band", "value", F.col("c.doc").alias("centre"), F.col("c.root").alias("centre_root")))
    return (members.join(centres, ["band", "value"]).where("root <> centre_root")
            .select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct())


def neighbour_pairs(members: DataFrame, signatures: DataFrame, bands: int, stride: int, agree: int, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """Distinct (a, b) of different classes among neighbours in a bucket of (band, value, doc, root).

    The members of a bucket are sorted by ``depth`` further sketches of theirs, at distances of ``stride`` bands from the bucket's own, and
    each is paired with those of the ``width`` before it that share ``agree`` of all sketches, of each class with the one that
    shares most. All buckets are sorted together by ranges, so that a large one spreads over many tasks; nothing is compared across the
    ends of the ranges. ``signatures`` (doc, sig) has for each band a number of the document's sketch, 0 if none has the same.
    """
    key = F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda k: F.element_at("sig", ((F.col("band") + k * stride) % bands + 1).cast("int")))
    ordered = members.join(signatures, "doc").select("band", "value", key.alias("key"), "doc", "root", "sig")
    ordered = ordered.repartitionByRange("band", "value", "key", "doc").sortWithinPartitions("band", "value", "key", "doc")
    kind = members.schema["doc"].dataType.simpleString()

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            old = 0 if held is None else held.num_rows
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            band, value = (table.column(c).to_numpy() for c in ("band", "value"))
            doc = table.column("doc").combine_chunks()
            root = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
            sketches = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, bands)
            found = []
            for d in range(1, width + 1):
                at = np.arange(max(old, d), len(band))
                at = at[(band[at] == band[at - d]) & (value[at] == value[at - d]) & (root[at] != root[at - d])]
                shared = ((sketches[at] == sketches[at - d]) & (sketches[at] != 0)).sum(axis=1)
                found.append(np.stack([at - d, at, shared])[:, shared >= agree])
            # Of the neighbours of a document that are of one other class, the nearest.
            ends = np.concatenate(found, axis=1)
            for member, other in ((1, 0), (0, 1)):
                ends = ends[:, np.lexsort((-ends[2], root[ends[other]], ends[member]))]
                new = (np.diff(ends[member]) != 0) | (np.diff(root[ends[other]]) != 0)
                ends = ends[:, np.append(True, new)[: ends.shape[1]]]
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(ends[0])), doc.take(pa.array(ends[1]))], names=["a", "b"])
            held = table.slice(max(0, table.num_rows - width))

    found = ordered.select("band", "value", "doc", "root", "sig").mapInArrow(run, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def classed(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """The members (band, value, doc, mates) of buckets that hold several classes, with their class ``root``."""
    roots = components(links).withColumnRenamed("node", "doc")
    out = settle(buckets.join(roots, "doc", "left").withColumn("root", F.coalesce("root", "doc")))
    mixed_up = out.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "value")
    return settle(out.join(mixed_up, ["band", "value"], "left_semi"))


def cells(members: DataFrame, size: int = CELL) -> DataFrame:
    """(band, value, i, j, chunk, doc, root) of (band, value, doc, root): every pair of different classes of a bucket meets in one cell (i, j).

    A bucket of up to ``size`` members is one cell. In a larger one the members outside of its largest class are dealt into chunks that
    meet each other and the chunks of that class, whose own members do not meet again: a row is repeated once for each ``size`` of the others.
    """
    large = small_side(settle(members.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > size).select("band", "value")))
    classes = members.join(large, ["band", "value"]).groupBy("band", "value", "root").agg(F.count("*").alias("n"))
    sizes = small_side(settle(classes.groupBy("band", "value").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))))
    whole, chunks = F.col("n").isNull(), lambda n: F.ceil(n / size).cast("int")
    dealt = (members.join(sizes, ["band", "value"], "left")
             .withColumn("kr", F.when(whole, 1).otherwise(chunks(F.col("n") - F.col("most.n")))).withColumn("km", F.when(whole, 0).otherwise(chunks(F.col("most.n"))))
             .withColumn("main", ~whole & (F.col("root") == F.col("most.root"))))
    by_chance = lambda k: F.pmod(F.xxhash64("doc"), F.greatest(k, F.lit(1))).cast("int")
    dealt = dealt.withColumn("chunk", F.when(F.col("main"), F.col("kr") + by_chance(F.col("km"))).otherwise(by_chance(F.col("kr"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("main"), F.col("kr")).otherwise(F.col("kr") + F.col("km")) - 1)))
    return dealt.select("band", "value", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "doc", "root")


class Aligned:
    """Comparisons among rows with ``words``: which pairs can be similar enough, by what their counts of words allow, and which are."""

    def __init__(self, table: pa.Table, threshold: float) -> None:
        lists = table.column("words").combine_chunks()
        self.threshold, self.words = threshold, lists.flatten().to_numpy()
        self.ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        self.n = np.diff(self.ends)
        self.counts = binned(self.words, self.n)

    def meeting(self, rows: np.ndarray, begin: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of these rows with the rows from ``begin`` to ``until``: all that may be similar."""
        return every_pair(rows, begin, until)

    def need(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.ceil(self.threshold * (self.n[x] + self.n[y]) / (1 + self.threshold) - 1e-9).astype(np.int64)

    def possible(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a common subsequence can be long enough, and an order in which pairs are tried, the likely ones last."""
        need, share = self.need(x, y), np.zeros(len(x))
        some = np.flatnonzero(np.minimum(self.n[x], self.n[y]) >= need)
        common = in_common(self.counts, x[some], y[some])
        share[some] = common / (self.n[x[some]] + self.n[y[some]])
        keep = np.zeros(len(x), bool)
        keep[some] = common >= need[some]
        return keep, share

    #: Pairs that are verified before the classes that their links join are looked at again.
    TOGETHER = 1

    def alike(self, x: int, y: int) -> bool:
        a, b = (self.words[self.ends[k]: self.ends[k + 1]] for k in (x, y))
        need = int(self.need(x, y))
        return common_subsequence(a, b, need) >= need

    def similar(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.fromiter((self.alike(a, b) for a, b in zip(x.tolist(), y.tolist())), bool, len(x))


def every_pair(rows: np.ndarray, begin: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the rows with all rows from its ``begin`` to its ``until``."""
    n = until - begin
    x = np.repeat(rows, n)
    return x, np.arange(len(x)) + np.repeat(begin - np.cumsum(n) + n, n)


def binned(values: np.ndarray, lengths: np.ndarray, bins: int = BINS) -> np.ndarray:
    """How many of the values of each row fall into each bin."""
    kind, parts, ends = np.uint8, [np.empty((0, bins), np.uint8)], np.concatenate([[0], np.cumsum(lengths)])
    for first in range(0, len(lengths), CELL):
        own = lengths[first: first + CELL]
        at = np.repeat(np.arange(len(own)), own) * bins + (values[ends[first]: ends[first + len(own)]].astype(np.int64) & (bins - 1))
        counts = np.bincount(at, minlength=len(own) * bins).reshape(len(own), bins)
        parts.append(counts.astype(np.min_scalar_type(counts.max())))
        kind = np.promote_types(kind, parts[-1].dtype)
    return np.concatenate(parts, dtype=kind)


def in_common(counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs of rows the sum of the smaller counts: no fewer than they have values in common."""
    parts = [np.minimum(counts[x[k: k + 8192]], counts[y[k: k + 8192]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), 8192)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def first_meeting(places: np.ndarray, lengths: np.ndarray, place: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """For pairs of rows whether ``place`` is the least of the places that both rows have; ``places`` are those of all rows, so many a row as ``lengths`` says."""
    known, number = np.unique(places, return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    held = np.sort(np.repeat(np.arange(len(lengths)), lengths) * len(known) + number)
    own = np.searchsorted(known, place)

    def here(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        some = np.flatnonzero((lengths[x] > 1) & (lengths[y] > 1))
        for k in range(0, len(some), BLOCK):
            a, b = x[some[k: k + BLOCK]], y[some[k: k + BLOCK]]
            # The places of the first row that are less than this one, looked up among those of the other.
            pair = np.repeat(np.arange(len(a)), lengths[a])
            value = held[ends[a][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(lengths[a]) - lengths[a], lengths[a])] - (a * len(known))[pair]
            less = value < own[a][pair]
            pair, value = pair[less], value[less] + (b * len(known))[pair[less]]
            both = held[np.minimum(np.searchsorted(held, value), len(held) - 1)] == value
            out[some[k + pair[both]]] = False
        return out

    return here


def links_in_cells(members: DataFrame, content: DataFrame, compare: Callable[[pa.Table], Aligned]) -> DataFrame:
    """Links (a, b) that join all classes of (band, value, doc, root) that a pair of similar documents in a bucket joins.

    No pair is left out: every pair of different classes is held against ``compare(...).meeting`` and ``possible``, which rule out only what cannot be
    similar, and the rest is verified by ``similar`` where ``members`` first bring the two together, unless links of the same task have joined
    their classes. ``content`` (doc, ...) is what ``compare`` needs; rows leave a task for links alone.
    """
    # A document and what is needed of it meet once, with all its cells. Buckets of a single class bring no pair together.
    held = cells(members).select("doc", F.struct(F.xxhash64("band", "value").alias("place"), "i", "j", "chunk", "root").alias("cell")).repartition("doc").groupBy("doc").agg(F.collect_list("cell").alias("cells"))
    dealt = content.join(held, "doc").withColumn("places", F.array_distinct("cells.place")).withColumn("cell", F.explode("cells")).drop("cells").select("cell.*", *content.columns, "places")
    key = ["place", "i", "j"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "chunk")
    kind = members.schema["doc"].dataType.simpleString()

    def joined(table: pa.Table) -> pa.RecordBatch:
        place, i, j, chunk = (table.column(c).to_numpy() for c in ("place", "i", "j", "chunk"))
        doc = table.column("doc").combine_chunks()
        root = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        lists = table.column("places").combine_chunks()
        here = first_meeting(lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), place)
        among = compare(table)
        rows, new = np.arange(len(place)), np.append(True, (place[1:] != place[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        after = lambda new: np.append(np.flatnonzero(new), len(place))[np.cumsum(new)]
        # A chunk meets itself, or the other chunk of its cell, which comes after it.
        until = after(new)
        start = np.where(i == j, rows + 1, after(new | np.append(True, chunk[1:] != chunk[:-1])))
        parent, roots = list(range(int(root.max(initial=-1)) + 1)), root.tolist()

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sums = np.cumsum(until - start)
        links: list[tuple[int, int]] = []

        def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Whether no links have joined the classes of pairs yet."""
            tops = np.array(parent)
            while (tops[tops] != tops).any():
                tops = tops[tops]
            return tops[root[x]] != tops[root[y]]

        def verify(x: np.ndarray, y: np.ndarray) -> None:
            # Pairs of classes that are joined by now go without a look at each.
            for begin in range(0, len(x), BLOCK):
                still = apart(x[begin: begin + BLOCK], y[begin: begin + BLOCK])
                a, b = x[begin: begin + BLOCK][still], y[begin: begin + BLOCK][still]
                for k in range(0, len(a), among.TOGETHER):
                    u, v = a[k: k + among.TOGETHER], b[k: k + among.TOGETHER]
                    if among.TOGETHER > 1:
                        still = apart(u, v)
                        u, v = u[still], v[still]
                    elif top(roots[u[0]]) == top(roots[v[0]]):
                        continue
                    good = among.similar(u, v)
                    for c, d in zip(u[good].tolist(), v[good].tolist()):
                        if top(roots[c]) != top(roots[d]):
                            parent[top(roots[c])] = top(roots[d])
                            links.append((c, d))

        first, found = 0, []
        while first < len(rows):
            # As many rows as have PAIRS pairs with the rows after them in their cells, one at least.
            stop = max(first + 1, int(np.searchsorted(sums, (sums[first - 1] if first else 0) + PAIRS, side="right")))
            x, y = among.meeting(rows[first:stop], start[first:stop], until[first:stop])
            keep = root[x] != root[y]
            x, y = x[keep], y[keep]
            keep, order = among.possible(x, y)
            x, y, order = x[keep], y[keep], order[keep]
            keep = here(x, y)
            found.append((x[keep], y[keep], order[keep]))
            first = stop
            if first == len(rows) or sum(len(f[0]) for f in found) >= BLOCK:
                x, y, order = (np.concatenate(z) for z in zip(*found))
                order = np.argsort(-order, kind="stable")
                verify(x[order], y[order])
                found = []
        ends = [pa.array([e[k] for e in links], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([doc.take(e) for e in ends], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS_TOGETHER and sum(b.nbytes for b in held) < BYTES_TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            # The last cell may go on in the next batch.
            ends = np.zeros(table.num_rows, bool)
            for c in key:
                values = table.column(c).to_numpy()
                ends[1:] |= values[1:] != values[:-1]
            cut = int(np.flatnonzero(ends)[-1]) if ends.any() else 0
            if cut:
                yield joined(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            yield joined(table)

    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def bucket_links(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], bands: int, agree: int,
                 rest: Callable[[DataFrame], DataFrame] | None = None, least: int = 1) -> DataFrame | None:
    """The verified links (a, b) among the documents of buckets (band, value, doc, sketch), or None if no bucket has two.

    ``verify`` keeps the rows (a, b) of similar documents; ``sketch`` is the document's sketch in the band. First all members of a bucket of
    more than ``least`` are compared with the one that shares most buckets with others, which is the nearest to all of a group of copies.
    ``rest`` (see :func:`links_in_cells`) then gets the members of the buckets that still hold several classes
    and finds all links that are left. Without it the choice is a sample: the members of other classes are compared with one by
    chance, then with their neighbours, in as many orders as ``STRIDES`` (see :func:`neighbour_pairs`), if they share ``agree`` sketches; a link between
    documents that are never neighbours in any bucket that they share is found only by other links of theirs.
    """
    sizes = settle(buckets.groupBy("band", "value").agg(F.count("*").alias("size")).where(F.col("size") > least))
    several = sizes if least <= 1 else buckets
    if several.isEmpty():
        return None
    every = buckets.join(sizes if least <= 1 else small_side(sizes), ["band", "value"])
    every = settle(every.join(every.groupBy("doc").agg(F.sum("size").alias("mates")), "doc"))
    chance = lambda salt: F.xxhash64("doc", F.lit(salt))
    tested: list[DataFrame] = []
    good: list[DataFrame] = []
    members = every.select("band", "value", "doc", "mates", "size").withColumn("root", F.col("doc"))
    signatures = None
    for step in ["most"] if rest else ["most", "chance", *STRIDES]:
        if good:
            members = classed(members.select("band", "value", "doc", "mates", "size"), reduce(DataFrame.unionByName, good))
        if step in ("most", "chance"):
            pairs = star_pairs(members, F.struct(-F.col("mates"), chance(0)) if step == "most" else chance(1))
        else:
            if signatures is None:
                # 31 bits of each sketch; at most ``bands`` entries a document.
                short = F.struct("band", F.greatest(F.col("sketch").bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(1)).cast("int").alias("sketch"))
                held = (every.join(members.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.map_from_entries(F.collect_set(short)).alias("m")))
                signatures = settle(held.select("doc", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))).alias("sig")))
            pairs = neighbour_pairs(members, signatures, bands, step, agree)
        if tested:
            pairs = pairs.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti")
        pairs = settle(pairs)
        if pairs.isEmpty():
            continue
        tested.append(pairs)
        found = settle(verify(pairs))
        if not found.isEmpty():
            good.append(found)
    if rest:
        members = buckets.select("band", "value", "doc")
        members = classed(members, reduce(DataFrame.unionByName, good)) if good else members.withColumn("root", F.col("doc"))
        good.append(settle(rest(members)))
    return reduce(DataFrame.unionByName, good) if good else tested[0].limit(0)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, exact: bool = True) -> DataFrame:
    """(key, class_id): one row a distinct key, with the smallest key of its near-duplicate class.

    Exact copies form one class first, and their smallest key stands for all of them from there on. Documents that share a
    sketch, and whose lengths allow the similarity, are in a bucket, and no link between members of a bucket is lost; without ``exact`` the pairs
    of a bucket that are aligned are a choice (see :func:`bucket_links`). Classes are connected components of the links. A text without words (null or empty too) is in a class by
    itself; a text of fewer than five words only with its exact copies. Rows with a null key are left out; a repeated
    key is one document, linked as any of its texts is. Other columns are not read; an empty table gives none.
    """
    rows = df.select(F.col(f"`{key}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("doc is not null")
    has_words = F.col("text").rlike(r"[A-Za-z0-9]|[^\x00-\x7F]")
    hashed = settle(rows.select("doc", F.when(has_words, F.unhex(F.sha2("text", 256))).alias("h")).distinct())
    copies = settle(hashed.where("h is not null").groupBy("h").agg(F.min("doc").alias("rep")))
    same = hashed.join(copies, "h").where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    reps = copies.select(F.col("rep").alias("doc")).distinct()
    sketches = settle(document_sketches(rows).join(reps, "doc", "left_semi"))
    # Two lengths within the threshold are in one class of lengths or in neighbouring ones: each document joins its own and the next.
    grade = F.floor(F.log("n") / (max(-math.log(threshold), 1e-6) * (1 + 1e-9)))
    graded = sketches.select("doc", "band", F.col("value").alias("sketch"), F.explode(F.array(grade, grade + 1)).alias("grade")).select(
        "doc", "band", "sketch", F.xxhash64("sketch", "grade").alias("value"))
    crowded = graded.groupBy("band", "value").count().where("count > 1").drop("count")
    buckets = settle(graded.join(crowded, ["band", "value"], "left_semi"))
    sets = settle(sequences(rows.join(buckets.select("doc").distinct(), "doc", "left_semi"), "text"))

    def verify(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("doc").alias("a"), F.col("words").alias("sa"))
        right = sets.select(F.col("doc").alias("b"), F.col("words").alias("sb"))
        return verified(pairs.join(left, "a").join(right, "b"), threshold).select("a", "b").distinct()

    def rest(members: DataFrame) -> DataFrame:
        return links_in_cells(members, sets, lambda table: Aligned(table, threshold))

    links = bucket_links(buckets, verify, SKETCHES, AGREE, rest if exact else None)
    every = same if links is None else same.unionByName(links)
    roots = components(every).withColumnRenamed("node", "doc")
    return (hashed.select("doc").distinct().join(roots, "doc", "left")
            .select(F.col("doc").alias(key), F.coalesce("root", "doc").alias("class_id")))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose key stands for its near-duplicate class, with all their columns; null keys stay."""
    classes = near_duplicates(df, key, text, threshold)
    gone = classes.where(F.col(key) != F.col("class_id")).select(F.col(key).alias("__gone"))
    # Copies grow with the texts, so they meet them by a shuffle at every size.
    return df.join(gone.hint("merge"), F.col(f"`{key}`") == F.col("__gone"), "left_anti")
