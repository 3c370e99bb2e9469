"""Quality rules: a table of thresholds compiled into one projection.

Each rule bounds one ratio of lengths, symbols, stop words or lines. The measures and the verdicts are built-in
functions over the row's own words; there is no shuffle, and no user function.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, let

BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Bits for a window's place beside its hash.
PLACE_BITS = 20
#: A length beyond that of any array.
ALL = 2_000_000_000

#: Frequent function words of the four languages.
STOP_WORDS = """
the of and to a in is it that for on with as by be are this was or an he from at not have had his but they you we all her she
der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont ou avec son aux
el los que y del se las por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya
""".split()


class Rule(NamedTuple):
    """A text passes if ``low <= measure <= high``; an open end is None. ``reason`` names the rule in results."""

    reason: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The measures are columns of :func:`measured` or expressions over them.
RULES = [
    Rule("short_words", "word_chars / n_words", low=2.0),
    Rule("long_words", "word_chars / n_words", high=16.0),
    Rule("symbols", "n_symbols / n_words", high=0.25),
    Rule("exclamations", "n_exclamations / n_words", high=0.4),
    Rule("few_stop_words", "n_stop_words / n_words", low=0.03),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", high=0.6),
]


def _position_cover(positions: Column) -> Column:
    """Words that 3-word windows at the given ascending positions cover."""
    return F.aggregate(F.zip_with(positions, F.slice(positions, 2, ALL),
                                  lambda a, b: F.least(F.coalesce(b - a, F.lit(3).cast("long")), F.lit(3).cast("long"))),
                       F.lit(0).cast("long"), lambda s, x: s + x)


def _repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more, from the array of window hashes in text order.

    Low bits of the hash and the position share a number, so that one sort of numbers brings repeats together with
    their places. Where shortened hashes meet that differ in full, or a text has too many words for this, pairs of
    hash and position are sorted instead.
    """
    place = F.lit((1 << PLACE_BITS) - 1)
    packed = F.transform(windows, lambda x, i: F.shiftleft(x, PLACE_BITS).bitwiseOR(i.cast("long")))
    met = let(F.sort_array(packed), lambda s: F.filter(
        F.zip_with(s, F.slice(s, 2, ALL), lambda a, b: F.when(
            F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), F.array(a.bitwiseAND(place), b.bitwiseAND(place)))),
        lambda x: x.isNotNull()))
    repeats = let(F.sort_array(windows), lambda s: F.aggregate(
        F.zip_with(s, F.slice(s, 2, ALL), lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(0), lambda n, e: n + e.cast("int")))
    by_pairs = let(F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i")))), lambda s: F.filter(
        F.zip_with(s, F.slice(s, 2, ALL), lambda a, b: F.when(a.x == b.x, F.array(a.i, b.i))), lambda x: x.isNotNull()))
    cover = lambda pairs: let(F.sort_array(F.array_distinct(F.flatten(pairs))), _position_cover)
    short = let(met, lambda m: F.when(F.size(m) == 0, F.lit(0).cast("long")).when(F.size(m) == repeats, cover(m)).otherwise(cover(by_pairs)))
    return F.when(F.size(windows) < (1 << PLACE_BITS), short).otherwise(cover(by_pairs))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Columns n_words, word_chars, n_symbols, n_exclamations, n_lines, n_dup_lines, n_repeat_words and n_stop_words beside those of ``df``.

    Words are runs of characters outside space, tab, LF, VT, FF and CR. A null text counts as empty: all measures
    are 0. Windows of three words are compared by 64-bit hashes chained over the words' hashes.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(value, F.lit(BLANKS))
    hashes = F.when(bare == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(bare, BLANK_RUN, -1), lambda w: F.xxhash64(w)))
    lines = F.filter(F.split(value, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    pair = F.zip_with("__h", F.slice("__h", 2, ALL), lambda a, b: F.xxhash64(a, b))
    triple = F.zip_with(F.slice("__pair", 1, F.greatest(F.size("__h") - 2, F.lit(0))), F.slice("__h", 3, ALL),
                        lambda a, b: F.xxhash64(a, b))
    stop = [F.xxhash64(F.lit(w)) for w in dict.fromkeys(STOP_WORDS)]
    number = lambda pattern: F.regexp_count(value, F.lit(pattern))
    return (df.withColumn("__h", hashes).withColumn("__lines", lines).withColumn("__pair", pair).withColumn("__triple", triple)
            .withColumns({
                "n_words": F.size("__h").cast("long"),
                "word_chars": (F.char_length(value) - number(r"[\x20\x09-\x0D]")).cast("long"),
                "n_symbols": number(f"[{SYMBOLS}]").cast("long"),
                "n_exclamations": number("!").cast("long"),
                "n_lines": F.size("__lines").cast("long"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                "n_repeat_words": F.when(F.size(F.array_distinct("__triple")) < F.size("__triple"), _repeat_words(F.col("__triple"))).otherwise(0).cast("long"),
                "n_stop_words": F.size(F.filter("__h", lambda x: x.isin(stop))).cast("long"),
            }).drop("__h", "__lines", "__pair", "__triple"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def failed_rules(rules: list[Rule] = RULES) -> Column:
    """The reasons of the rules that a measured row breaks, as an array. A row without words breaks none."""
    tests = []
    for rule in rules:
        value, bad = F.expr(f"try_divide({rule.measure.replace(' / ', ', ')})") if rule.measure.count(" / ") == 1 else F.expr(rule.measure), F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        tests.append(F.when(bad, F.lit(rule.reason)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def judged(df: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """``df`` with the measures, ``base_failed``, ``reasons`` (rules broken) and ``kept``.

    Every row stays, repeated and empty ones too; null or blank texts have no words, fail the base rule and are not
    kept. Columns of ``df`` named like a result column are replaced. An empty table gives an empty result.
    """
    return (measured(df, text).withColumn("base_failed", base_failed()).withColumn("reasons", failed_rules(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)))


def quality_rules(df: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the base rule and all ``rules`` keep, with the columns of ``df`` alone."""
    names = [f"__own_{i}" for i, _ in enumerate(df.columns)]
    held = df.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)]).alias("__row"), F.col(f"`{text}`").alias("__text"))
    # A filter on columns of a projection that also holds the partition's number is not moved below it, where each use of a measure
    # would be computed anew.
    verdict = judged(held, rules, "__text").select("__row", "kept", F.spark_partition_id().alias("__part"))
    kept = verdict.where("kept and __part >= 0")
    return kept.select(*[F.col(f"__row.{n}").alias(c) for c, n in zip(df.columns, names)])
