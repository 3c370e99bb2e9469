"""Final ordering. Nothing downstream depends on row order, so sort once, at the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotfield.session import settle

#: Bits of a row's number inside its partition, as ``monotonically_increasing_id`` gives it.
ROW_BITS = 33


def _sort_keys(keys: Sequence[Column | str]) -> list[Column]:
    return [F.col(f"`{k}`").asc_nulls_last() if isinstance(k, str) else k for k in keys]


def arrange(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Sort ascending with missing values last."""
    return df.orderBy(*_sort_keys(keys))


def with_position(df: DataFrame, *keys: Column | str, name: str = "position") -> DataFrame:
    """Every row with its place, from 1, in the order of :func:`arrange`; ties take their places in any order.

    Ranges of the keys are sorted apart from each other and written once, each row with its number inside of its range; the
    sizes of the ranges before it, one row a partition, are then added. Give enough keys to split a frequent
    first one: rows with equal keys are in one range.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    by = _sort_keys(keys)
    placed = settle(df.repartitionByRange(*by).sortWithinPartitions(*by).select(
        *[F.col(f"`{c}`") for c in df.columns], F.spark_partition_id().alias("__range"), inside.alias("__inside")))
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__range", (F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")).alias("__before"))
    return placed.join(before, "__range").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__inside") + 1).alias(name))


def first_rows(df: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """First ``n`` rows in a stated order (sort and limit fuse into a bounded top-n)."""
    return arrange(df, *by).limit(n)
