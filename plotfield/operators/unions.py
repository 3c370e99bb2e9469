"""Row binding by column name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame

from plotfield.sources.tables import literal_table


def union_fill(*frames: DataFrame) -> DataFrame:
    """Stack by name; columns a frame lacks are missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_strict(*frames: DataFrame) -> DataFrame:
    """Stack by name; all frames must have the same columns."""
    names = set(frames[0].columns)
    for other in frames[1:]:
        if set(other.columns) != names:
            raise ValueError(f"column sets differ: {sorted(names ^ set(other.columns))}")
    return reduce(DataFrame.unionByName, frames)


def add_baseline(df: DataFrame, rows: Sequence[Sequence[Any]], columns: Sequence[str]) -> DataFrame:
    """Append a few literal rows, typed like ``df`` and given in ``columns`` order."""
    if set(columns) != set(df.columns):
        raise ValueError("baseline rows must name every column")
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.unionByName(literal_table(df.sparkSession, rows, ddl))
