"""Document quality by perplexity under an interpolated modified Kneser-Ney model.

Characters are spelt as units of six bits, each character in its own way, so that none is folded into another; the model predicts each
unit from the five before it, by language. It is trained on all trusted documents. Counts
are partial sums of map tasks, grouped by n-gram; discounts and back-off weights come from joins of the counts with
the totals of their contexts, sharded by language and context. The model grows with the different sequences of characters
in the corpus; it is scored in shards of bounded size, and the shards' log probabilities add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import settle, slices, small_side

#: Units, and the model's order in units. A unit takes six bits of a key.
SYMBOLS, ORDER, BITS = 64, 6, 6
#: N-grams that a scoring task holds at a time. A larger model is scored in several passes.
MODEL_ROWS = 4_000_000
#: Quantiles of the trusted documents' perplexities, by language, between which a document is kept.
LOW, HIGH = 0.0005, 0.9995
#: The thresholds are widened by this share of the distance to the median.
SLACK = 1.0


#: Characters of one unit, from 1 on; 0 begins a text and is no other unit.
SINGLE = " \nabcdefghijklmnopqrstuvwxyz0123456789.,;:!?-'\"()"


def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point the number of units that spell it, and these units in one number, the last one lowest.

    No two characters have the same units, and no character's units begin another's. ``SINGLE`` takes one unit; 50 makes the letter after it a
    capital; 51 to 60 and a unit are the other characters to U+017F, and Greek and Cyrillic from U+0370 to U+045F; 61 and two units those from there to
    U+13E0, 62 and three units all others to U+3D0BE, 63 and four the rest.
    """
    digits = SYMBOLS - 1
    codes = np.arange(0x110000, dtype=np.uint32)

    def spelt(lead: int, number: np.ndarray, size: int) -> np.ndarray:
        out = number // digits ** size + lead
        for k in reversed(range(size)):
            out = out << BITS | number // digits ** k % digits + 1
        return out

    sizes, units = np.full(len(codes), 5, np.uint8), spelt(63, codes, 4)
    for first, last, lead, size, base in ((0, digits ** 3, 62, 3, 0), (0x460, 0x460 + digits ** 2, 61, 2, 0x460), (0, 0x180, 51, 1, 0), (0x370, 0x460, 51, 1, 0x370 - 0x180)):
        sizes[first:last], units[first:last] = size + 1, spelt(lead, codes[first:last] - np.uint32(base), size)
    for k, c in enumerate(SINGLE):
        sizes[ord(c)], units[ord(c)] = 1, k + 1
        if c.isalpha():
            sizes[ord(c.upper())], units[ord(c.upper())] = 2, 50 << BITS | k + 1
    return sizes, units


SIZES, UNITS = alphabet()


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each unit, with beginnings before the first one, and the rows' offsets."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes, units = SIZES[codes], UNITS[codes]
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    offsets = ends[np.concatenate([[0], np.cumsum(lengths)])]
    symbols = np.empty(ends[-1], np.uint8)
    symbols[ends[1:] - 1] = units & np.uint32(SYMBOLS - 1)
    rest = np.flatnonzero(sizes > 1)
    for k in range(1, 5):
        rest = rest[sizes[rest] > k]
        symbols[ends[rest + 1] - 1 - k] = units[rest] >> np.uint32(BITS * k) & np.uint32(SYMBOLS - 1)
    padded = np.zeros(len(symbols) + (ORDER - 1) * len(texts), np.uint64)
    at = np.arange(len(symbols)) + (ORDER - 1) * (np.repeat(np.arange(len(texts)), np.diff(offsets)) + 1)
    padded[at] = symbols
    keys = np.zeros(len(symbols), np.uint64)
    for k in range(ORDER):
        keys = keys << np.uint64(BITS) | padded[at - (ORDER - 1 - k)]
    return keys, offsets


def ngram_counts(df: DataFrame) -> DataFrame:
    """(lang, key, n): counts of the highest order in all texts of (lang, text)."""
    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                own = batch.filter(pa.array([x == lang for x in langs]))
                for part in slices(own, "text"):
                    keys, counts = np.unique(encoded(part.column(1).to_pylist())[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "key", "n"])

    return df.mapInArrow(run, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def discounted(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Of (lang, key, n): (lang, key, p), the discounted share of each n-gram, and (lang, key, g), each context's back-off weight.

    The three discounts follow from how many n-grams occur once to four times. Where a language has too few n-grams
    for that, a discount is half of the count it applies to, one at most.
    """
    times = lambda k: F.sum((F.col("n") == k).cast("double"))
    many = counts.groupBy("lang").agg(*[times(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = "n1 / (n1 + 2 * n2)"
    bounded = lambda k: F.expr(f"CASE WHEN n{k} > 0 AND n1 > 0 THEN greatest(0.1, least({k} - 0.05, {k} - {k + 1} * {y} * n{k + 1} / n{k})) ELSE least(1, {k} / 2) END")
    rates = many.select("lang", *[bounded(k).cast("double").alias(f"d{k}") for k in (1, 2, 3)])
    taken = (counts.join(small_side(settle(rates)), "lang")
             .withColumn("context", F.shiftrightunsigned("key", BITS)).withColumn("d", F.expr("CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END")))
    contexts = taken.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("lost"))
    shares = taken.join(contexts, ["lang", "context"]).select("lang", "key", ((F.col("n") - F.col("d")) / F.col("total")).alias("p"))
    return shares, contexts.select("lang", F.col("context").alias("key"), (F.col("lost") / F.col("total")).alias("g"))


def train(trusted: DataFrame) -> DataFrame:
    """The model of the texts of (lang, text): (lang, kind, level, key, value). Kind 0 has discounted shares of n-grams
    of length ``level``, kind 1 the back-off weights of contexts of length ``level``."""
    counts = settle(ngram_counts(trusted))
    parts = []
    for level in range(ORDER, 0, -1):
        shares, weights = discounted(counts, level)
        for kind, side, size, value in ((0, shares, level, "p"), (1, weights, level - 1, "g")):
            parts.append(side.select("lang", F.lit(kind).alias("kind"), F.lit(size).alias("level"), "key", F.col(value).cast("double").alias("value")))
        if level > 1:
            # How many different symbols stand before the shorter n-gram.
            mask = (1 << BITS * (level - 1)) - 1
            counts = settle(counts.groupBy("lang", F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.count("*").alias("n")))
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    return settle(model)


class Scorer:
    """Log probabilities of a shard of one language's model, from sorted keys of each length."""

    def __init__(self, kind: np.ndarray, level: np.ndarray, key: np.ndarray, value: np.ndarray) -> None:
        def ordered(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
            own = np.flatnonzero((kind == which) & (level == size))
            own = own[np.argsort(key[own])]
            return key[own], value[own]

        self.weights = [ordered(1, size) for size in range(ORDER)]
        # Of each n-gram seen the share, and what is left to the shorter one, which is seen too.
        low = np.full(SYMBOLS, 1 / SYMBOLS, np.float32) * (self.weights[0][1][0] if len(self.weights[0][1]) else 1.0)
        keys, shares = ordered(0, 1)
        low[keys] += shares
        self.single = low
        self.ngrams = [(np.arange(SYMBOLS), low)]
        for size in range(2, ORDER + 1):
            keys, shares = ordered(0, size)
            shorter, p = self.ngrams[-1]
            contexts, weights = self.weights[size - 1]
            if len(keys):
                p = shares + weights[np.searchsorted(contexts, keys >> BITS)] * p[np.searchsorted(shorter, keys & ((1 << BITS * (size - 1)) - 1))]
            self.ngrams.append((keys, p if len(keys) else shares))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys, where = np.unique(keys.view(np.int64), return_inverse=True)
        out, weight = np.zeros(len(keys)), np.ones(len(keys))
        left = np.arange(len(keys))
        for size in range(ORDER, 1, -1):
            seen, at = found(self.ngrams[size - 1][0], keys[left] & ((1 << BITS * size) - 1))
            out[left[seen]] = self.ngrams[size - 1][1][at[seen]]
            left = left[~seen]
            # A context that was never seen leaves all to the shorter n-gram.
            seen, at = found(self.weights[size - 1][0], keys[left] >> BITS & ((1 << BITS * (size - 1)) - 1))
            weight[left[seen]] *= self.weights[size - 1][1][at[seen]]
        out[left] = self.single[keys[left] & (SYMBOLS - 1)]
        return np.log(np.maximum(out * weight, 1e-12))[where]


def found(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the asked keys are among the sorted known ones, and where."""
    if not len(known):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return known[at] == asked, at


#: The most shards: they follow from the two units before the predicted one.
SHARDS = SYMBOLS ** 2


def shard_of(context, shards: int):
    """The shard of contexts, as a column or an array, by their last two units."""
    pair = context.bitwiseAND(F.lit(SHARDS - 1)) if isinstance(context, Column) else context & (SHARDS - 1)
    return pair * 1597 % SHARDS % shards


def log_probabilities(spark: SparkSession, docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc, total, n) of (doc, lang, text): the sum of the units' log probabilities, and the number of characters.

    A shard holds what is needed for the units after some pairs of units. N-grams of two units and fewer are in
    every shard. A language without a model gives no row.
    """
    n = model.count()
    shards = min(SHARDS, max(1, -(-n // MODEL_ROWS)))
    context = F.when(F.col("kind") == 1, F.col("key")).otherwise(F.shiftrightunsigned("key", BITS))
    langs = [r.lang for r in model.select("lang").distinct().collect()]
    parts = []
    for shard in range(shards):
        own = model.where((F.col("level") + F.col("kind") <= 2) | (shard_of(context, shards) == shard))
        scorers = {}
        for lang in langs:
            # One language at a time on the driver, in as few bytes as hold it.
            held = own.where(F.col("lang") == lang).select(F.col("kind").cast("tinyint"), F.col("level").cast("tinyint"), "key", F.col("value").cast("float")).toArrow()
            scorers[lang] = Scorer(*[c.to_numpy() for c in held.columns])
            del held
        parts.append(_scored(docs, spark.sparkContext.broadcast(scorers), shard, shards))
        del scorers
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return scored.groupBy("doc").agg(F.sum("total").alias("total"), F.sum("n").alias("n")) if shards > 1 else scored


def _scored(docs: DataFrame, held, shard: int, shards: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                if lang not in held.value:
                    continue
                own = batch.filter(pa.array([x == lang for x in langs]))
                for part in slices(own, "text"):
                    texts = part.column(2).to_pylist()
                    keys, offsets = encoded(texts)
                    if shards > 1:
                        mine = np.flatnonzero(shard_of(keys.view(np.int64) >> BITS, shards) == shard)
                        offsets, keys = np.searchsorted(mine, offsets), keys[mine]
                    sums = np.concatenate([[0.0], np.cumsum(held.value[lang](keys))])
                    sizes = np.fromiter(map(len, texts) if shard == 0 else (0 for _ in texts), np.int64, len(texts))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(sums[offsets[1:]] - sums[offsets[:-1]]), pa.array(sizes)], names=["doc", "total", "n"])

    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, total double, n bigint")


def classified(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", trusted: str = "quality = 1 AND toxic = 0",
               low: float = LOW, high: float = HIGH) -> DataFrame:
    """(key, lang, n_chars, perplexity, kept) for every row of ``df``.

    The rows of ``labels`` that fulfil ``trusted`` name the training texts, all of which are used. A document is kept
    if its perplexity lies between two quantiles of its language's trusted documents. A null text counts as empty, a
    null language as the language ''. An empty text, or one in a language without trusted text, has no perplexity and
    is not kept. Keys must differ; rows with a null key are dropped; other columns are not read. Empty labels keep none.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{key}`").alias("doc"), F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("doc is not null")
    chosen = small_side(settle(labels.where(F.expr(trusted)).select(F.col(f"`{key}`").alias("doc")).distinct()))
    model = train(docs.join(chosen, "doc", "left_semi").select("lang", "text"))
    scores = settle(log_probabilities(spark, docs, model).where("n > 0").select("doc", "n", F.exp(-F.col("total") / F.col("n")).alias("perplexity")))
    named = docs.select("doc", "lang").join(scores, "doc", "left")
    bounds = (named.join(chosen, "doc", "left_semi").where("perplexity is not null").groupBy("lang")
              .agg(F.percentile_approx("perplexity", [low, 0.5, high], 10_000).alias("q"))
              .select("lang", (F.col("q")[0] - SLACK * (F.col("q")[1] - F.col("q")[0])).alias("least"), (F.col("q")[2] + SLACK * (F.col("q")[2] - F.col("q")[1])).alias("most")))
    return (named.join(small_side(settle(bounds)), "lang", "left")
            .select(F.col("doc").alias(key), "lang", F.coalesce("n", F.lit(0)).cast("long").alias("n_chars"), "perplexity",
                    F.coalesce(F.col("perplexity").between(F.col("least"), F.col("most")), F.lit(False)).alias("kept")))
