"""Joins in which missing keys match each other, and complete design grids.

No side is broadcast by hint unless it is a short inline table, whose size is known. For tables,
the optimizer broadcasts below its threshold and otherwise sort-merges, where adaptive
skew-join splitting spreads a hot key over several tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from plotfield.sources.tables import literal_table

#: Rows up to which an inline table is broadcast; a longer one takes part in an ordinary join.
BROADCAST_ROWS = 10_000

Keys = Sequence[str | tuple[str, str]]


def _pairs(on: str | Keys) -> list[tuple[str, str]]:
    keys = [on] if isinstance(on, str) else list(on)
    return [(k, k) if isinstance(k, str) else tuple(k) for k in keys]


def _prepared(left: DataFrame, right: DataFrame, on: str | Keys, suffixes: tuple[str, str] | None):
    """Right side under private key names, plus the null-safe condition."""
    pairs = _pairs(on)
    key_names = {r: f"__key_{i}" for i, (_, r) in enumerate(pairs)}
    clash = [c for c in right.columns if c not in key_names and c in left.columns]
    if clash and suffixes is None:
        raise ValueError(f"columns on both sides: {clash}; rename or pass suffixes")
    if clash:
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    right = right.withColumnsRenamed(key_names)
    condition = reduce(
        Column.__and__,
        [F.col(f"`{l}`").eqNullSafe(F.col(key_names[r])) for l, r in pairs],
    )
    return left, right, condition, list(key_names.values())


def _join(left, right, on, how, suffixes=None) -> DataFrame:
    left, right, condition, keys = _prepared(left, right, on, suffixes)
    return left.join(right, condition, how).drop(*keys)


def inner_join(
    left: DataFrame, right: DataFrame, on: str | Keys, suffixes: tuple[str, str] | None = None
) -> DataFrame:
    return _join(left, right, on, "inner", suffixes)


def left_join(
    left: DataFrame, right: DataFrame, on: str | Keys, suffixes: tuple[str, str] | None = None
) -> DataFrame:
    """Left join on one or several keys; repeated matches repeat the left row."""
    return _join(left, right, on, "left", suffixes)


def lookup_join(
    df: DataFrame, rows: Sequence[Sequence[Any]], schema: StructType | str, on: str | Keys
) -> DataFrame:
    """Left join to an inline table, broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    table = literal_table(df.sparkSession, rows, schema)
    return _join(df, F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table, on, "left")


def _key_side(right: DataFrame, on: str | Keys) -> DataFrame:
    """One row per key. Combined on the map side, so a hot key costs one row per task."""
    return right.select(*[r for _, r in _pairs(on)]).distinct()


def semi_join(left: DataFrame, right: DataFrame, on: str | Keys) -> DataFrame:
    left, right, condition, _ = _prepared(left, _key_side(right, on), on, None)
    return left.join(right, condition, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: str | Keys) -> DataFrame:
    left, right, condition, _ = _prepared(left, _key_side(right, on), on, None)
    return left.join(right, condition, "left_anti")


def member_flag(left: DataFrame, right: DataFrame, on: str | Keys, name: str) -> DataFrame:
    """Add a boolean: does the row's key occur in ``right``?"""
    keys = _key_side(right, on).withColumn(name, F.lit(True))
    return _join(left, keys, on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def grid_over(df: DataFrame, dimensions: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Every row of ``df`` with every combination of the listed values."""
    for name, values in dimensions.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def grid(spark: SparkSession, dimensions: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Full design grid from value lists. Large integer keys may be given as a ``range``."""
    names = list(dimensions)
    first = names[0]
    values = dimensions[first]
    if isinstance(values, range):
        base = spark.range(values.start, values.stop, values.step).select(
            F.col("id").cast("int" if abs(values.stop) < 2**31 else "long").alias(first)
        )
    else:
        base = grid_over(spark.range(1), {first: values}).drop("id")
    return grid_over(base, {n: list(dimensions[n]) for n in names[1:]})


def complete(
    design: DataFrame, facts: DataFrame, on: str | Keys, fill: Any = 0
) -> DataFrame:
    """Facts on every row of the design; where there is none, ``fill``.

    A fact column that also exists in the design (a placeholder) replaces it.
    """
    keys = {r for _, r in _pairs(on)}
    values = [c for c in facts.columns if c not in keys]
    joined = left_join(design.drop(*values), facts, on)
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in values})
