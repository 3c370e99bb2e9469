"""Divergence of the sources of a language, on run-length columns.

The kept terms of a language are brought into an order in which equal counts stand together, and each source is a
column of counts over that order, kept as runs of equal counts. The runs of two sources are intersected at their
boundaries; each piece adds the divergence of its two shares times its length. The order is cut into blocks of a bounded
number of terms, and the sources of a block into tiles, so that a task holds a bounded part of the columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD_BYTE, settle, slices, small_side, text_bytes, word_hashes

#: Documents of a language that must hold a term, and ranks of the terms that a group is told by.
LEAST_DOCS, TOP = 10, 10
#: Terms in a block, rows after which a block ends early, and sources in a tile.
BLOCK, BLOCK_ROWS, TILE = 4096, 2_000_000, 256
#: Rows that a task adds up before it hands them on.
HELD_ROWS = 1_500_000
LETTER_BYTE = np.array([0 if 48 <= b <= 57 else int(WORD_BYTE[b]) for b in range(256)], np.uint8)

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS terms FROM documents),
     g AS (SELECT DISTINCT lang, source FROM d),
     w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
     kept AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM w) GROUP BY ALL HAVING count(*) >= 10),
     c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
     v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
     dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
     p AS (SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p FROM dense JOIN v USING (lang)),
     total AS (SELECT lang, term, sum(n) AS n FROM p GROUP BY ALL),
     q AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS BIGINT) AS q FROM total JOIN v USING (lang)),
     summed AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
                FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
     terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
     ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
                FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The folded bytes from each start to its end as strings."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LETTER_BYTE[data[at]])).cast(pa.string())


def _slice_counts(part: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a slice (lang, source, text), one row for each term of a group."""
    langs, sources = (pc.dictionary_encode(part.column(k)) for k in (0, 1))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    data, offsets = text_bytes(part.column(2))
    words, starts, ends, at = word_hashes(data, offsets, LETTER_BYTE)
    row = np.repeat(np.arange(part.num_rows), np.diff(at))
    order = np.lexsort((row, words, group[row]))
    words, row, group = words[order], row[order], group[row[order]]
    new_term = np.append(True, (words[1:] != words[:-1]) | (group[1:] != group[:-1]))[: len(words)]
    new_doc = new_term | np.append(True, row[1:] != row[:-1])[: len(words)]
    first = np.flatnonzero(new_term)
    n = np.diff(np.append(first, len(words)))
    docs = np.add.reduceat(new_doc.astype(np.int64), first) if len(first) else n
    one = order[first]
    return pa.table({
        "lang": langs.dictionary.take(pa.array(group[first] // max(1, len(sources.dictionary)))),
        "source": sources.dictionary.take(pa.array(group[first] % max(1, len(sources.dictionary)))),
        "term": _strings(data, starts[one], ends[one]), "n": pa.array(n), "docs": pa.array(docs)})


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text): occurrences and holding rows of each term of a group.

    Tasks add up what they meet before it is shuffled by language and term.
    """
    keys = ["lang", "source", "term"]

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*keys, "n", "docs"])

    def run(batches):
        held, new, rows, base = [], [], 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                new.append(_slice_counts(part))
                rows += new[-1].num_rows
                # Merge once the new rows are as many as the merged ones, so that the work stays in proportion.
                if rows > max(base, HELD_ROWS // 4):
                    merged = added(held + new)
                    held, new, rows, base = [merged], [], 0, merged.num_rows
                    if base > HELD_ROWS:
                        yield from merged.to_batches(50_000)
                        held, base = [], 0
        if held or new:
            yield from added(held + new).to_batches(50_000)

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.repartition("lang", "term").groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, total, lead, sources, top, top_n, mark): the counts of the kept terms, with the sum over the
    language; ``lead`` is true in one row of each term, and the other columns bring terms with alike counts together."""
    term = Window.partitionBy("lang", "term")
    # The term's largest source, and a sum that is the same for terms whose sources all have the same counts.
    largest = F.max(F.struct("n", "source")).over(term)
    mark = F.bit_xor(F.xxhash64("source", "n")).over(term)
    counted = term_counts(docs).select(
        "lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), F.count("*").over(term).alias("sources"),
        largest.alias("largest"), mark.alias("mark"))
    return settle(counted.where(F.col("docs") >= least).select(
        "lang", "source", "term", "n", "total", (F.col("source") == F.col("largest.source")).alias("lead"), "sources",
        F.col("largest.source").alias("top"), F.col("largest.n").alias("top_n"), "mark"))


def share(n: str, occurrences: str = "group_n", kept: str = "terms") -> Column:
    """1 + floor(10 ** 9 * (n + 2) / (N + 2 V)), in whole numbers of any size."""
    return F.expr(f"1 + (cast(1000000000 as decimal(38, 0)) * (cast({n} as decimal(28, 0)) + 2)) div cast({occurrences} + 2 * {kept} as decimal(38, 0))")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def run_columns(kept: DataFrame, block: int = BLOCK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(lang, block, width, source, start, length, n): the columns of counts of the reordered terms as runs of equal counts
    above zero, cut at the ends of blocks of ``width`` terms."""
    ordered = (kept.repartitionByRange("lang", "sources", "top", "top_n", "mark", "term")
               .sortWithinPartitions("lang", "sources", "top", "top_n", "mark", "term").select("lang", "term", "source", "n"))

    def runs(lang: str, source: pa.Array, place: np.ndarray, n: np.ndarray, width: int, number: int) -> pa.RecordBatch:
        codes = source.dictionary_encode()
        own = codes.indices.to_numpy()
        order = np.lexsort((place, own))
        own, place, n = own[order], place[order], n[order]
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1) | (n[1:] != n[:-1])))
        length = np.diff(np.append(first, len(own)))
        m = len(first)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]).take(pa.array(np.zeros(m, np.int32))), pa.array(np.full(m, number)), pa.array(np.full(m, width, np.int32)), codes.dictionary.take(pa.array(own[first])),
             pa.array(place[first].astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(n[first])], names=["lang", "block", "width", "source", "start", "length", "n"])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            out, rest = cut(held, False)
            held = rest
            for lang, source, place, n, width in out:
                yield runs(lang, source, place, n, width, number)
                number += 1
        if held is not None and held.num_rows:
            for lang, source, place, n, width in cut(held, True)[0]:
                yield runs(lang, source, place, n, width, number)
                number += 1

    def cut(table: pa.Table, end: bool):
        """The whole blocks that a table of rows in order begins with, and the rest; all of it at the end."""
        lang, term = (table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term"))
        source, n = table.column("source").combine_chunks(), table.column("n").to_numpy()
        new_lang = np.append(True, lang[1:] != lang[:-1])
        terms = np.flatnonzero(new_lang | np.append(True, term[1:] != term[:-1]))
        langs, blocks, at = set(np.flatnonzero(new_lang).tolist()), [], 0
        for k in range(1, len(terms) + 1):
            here = int(terms[k]) if k < len(terms) else len(n)
            last = k == len(terms)
            if last and not end:
                break
            if last or here in langs or k - at >= block or here - int(terms[at]) >= block_rows:
                a = int(terms[at])
                place = np.searchsorted(terms[at:k], np.arange(a, here), side="right") - 1
                blocks.append((table.column("lang")[a].as_py(), source.slice(a, here - a), place, n[a:here], k - at))
                at = k
        return blocks, table.slice(int(terms[at]) if at < len(terms) else table.num_rows)

    return settle(ordered.mapInArrow(run, "lang string, block long, width int, source string, start int, length int, n long"))


def tile_pairs(table: pa.Table) -> tuple[list[str], list[str], list[int]]:
    """Sums over one block of f times length, for the pairs of sources of a tile pair (source, tile, ta, tb, width, start, length,
    p, zero); a source's row of length 0 has its share of terms without occurrence, ``zero``."""
    width, ta, tb = (table.column(c)[0].as_py() for c in ("width", "ta", "tb"))
    codes = table.column("source").combine_chunks().dictionary_encode()
    own, tile = codes.indices.to_numpy(), table.column("tile").to_numpy()
    start, length, p, zero = (table.column(c).to_numpy() for c in ("start", "length", "p", "zero"))
    columns = {}
    order = np.lexsort((start, own))
    for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        some = rows[length[rows] > 0]
        lows, highs = start[some].astype(np.int64), (start[some] + length[some]).astype(np.int64)
        marks = np.unique(np.concatenate([[0], lows, highs]))
        marks = marks[marks < width]
        at = np.searchsorted(lows, marks, side="right") - 1
        shares = np.full(len(marks), zero[rows[0]], np.int64)
        inside = at >= 0
        inside[inside] = marks[inside] < highs[at[inside]]
        shares[inside] = p[some][at[inside]]
        columns[codes.dictionary[int(own[rows[0]])].as_py()] = (int(tile[rows[0]]), marks, shares)
    a_side = sorted(s for s, (t, _, _) in columns.items() if t == ta)
    b_side = sorted(s for s, (t, _, _) in columns.items() if t == tb)
    a_out, b_out, values = [], [], []
    for a in a_side:
        _, marks_a, shares_a = columns[a]
        for b in b_side:
            if ta == tb and a >= b:
                continue
            _, marks_b, shares_b = columns[b]
            marks = np.union1d(marks_a, marks_b)
            x = shares_a[np.searchsorted(marks_a, marks, side="right") - 1]
            y = shares_b[np.searchsorted(marks_b, marks, side="right") - 1]
            a_out.append(a)
            b_out.append(b)
            values.append(int(((x - y) * (x - y) // (x + y) * np.diff(np.append(marks, width))).sum()))
    return a_out, b_out, values


def pair_sums(runs: DataFrame, groups: DataFrame, tiles: int) -> DataFrame:
    """(lang, a, b, value): the sums of f over all kept terms, for each pair of sources of a language, once."""
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    known = small_side(groups.select("lang", "source", "group_n", "terms"))
    shares = runs.join(known, ["lang", "source"]).select(
        "lang", "block", "width", "source", "start", "length", share("n").alias("p"), share("0").alias("zero"))
    # A block has a column for each source of its language, also where it holds none of its terms.
    blocks = runs.select("lang", "block", "width").distinct()
    none = F.lit(0).cast("int")
    whole = blocks.join(groups, "lang").select("lang", "block", "width", "source", none.alias("start"), none.alias("length"), F.lit(0).cast("long").alias("p"), share("0").alias("zero"))
    rows = shares.unionByName(whole).withColumn("tile", tile)
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    rows = rows.withColumn("other", other).withColumns({"ta": F.least("tile", "other"), "tb": F.greatest("tile", "other")}).drop("other")

    def run(table: pa.Table) -> pa.Table:
        a, b, values = tile_pairs(table)
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(values, pa.int64())})

    found = rows.groupBy("lang", "block", "ta", "tb").applyInArrow(run, "lang string, a string, b string, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, top: int = TOP,
                      tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from its others, and by which terms from the
    whole language.

    Null texts, languages and sources are empty strings. Every row counts as a document, repeated ones too. A language's
    kept terms are those in at least ``least`` of its documents; with none, its pairs have the value 0. Part ``pair`` ranks
    all other sources, part ``term`` the first ``top`` terms of which the source has a larger share than the language;
    equal values by the items' bytes. Other columns are not read. An empty table gives no row.
    """
    docs = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept = kept_counts(docs, least)
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count_if("lead").alias("leads"))
    of_lang = sizes.groupBy("lang").agg(F.sum("leads").alias("terms"), F.sum("group_n").alias("lang_n"))
    groups = settle(docs.select("lang", "source").distinct().join(sizes.drop("leads"), ["lang", "source"], "left").join(of_lang, "lang", "left")
                    .select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("group_n", "terms", "lang_n")]))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    sums = settle(pair_sums(run_columns(kept, block), groups, max(1, -(-most // tile))))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    empty = groups.where("terms = 0").select("lang", "source")
    others = empty.join(empty.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = both.select("lang", "s.source", "s.item", "value").unionByName(others)
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(group).alias("rank"))
    told = (kept.join(small_side(groups), ["lang", "source"])
            .select("lang", "source", F.col("term").alias("item"), share("n").alias("p"), share("total", "lang_n").alias("q")).where("p > q")
            .select("lang", "source", F.lit("term").alias("part"), "item", divergence("p", "q").alias("value"))
            .withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= top))
    return ranked.unionByName(told)
