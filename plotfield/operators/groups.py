"""Group-level facts attached to, or used to filter, the rows of the group.

Each is an aggregation joined back instead of a window: a window would sort and buffer a
whole group in one task, while here a hot group is pre-aggregated on the map side and its
rows stay spread out in the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plotfield.operators.joins import left_join, semi_join


def first_seen(
    df: DataFrame, keys: Sequence[str], time: str, name: str = "FirstYear"
) -> DataFrame:
    """Attach the earliest observed time of the group; missing times are ignored."""
    return left_join(df, df.groupBy(*keys).agg(F.min(time).alias(name)), list(keys))


def earliest_rows(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows at the group's earliest time, ties kept, exact duplicates dropped.

    A group with a missing time has no known minimum and yields no rows.
    """
    # Only duplicate-insensitive aggregates, so that the optimizer can drop joins below that
    # merely attach columns.
    known = F.when(~F.bool_or(F.col(time).isNull()), F.min(time))
    earliest = df.groupBy(*keys).agg(known.alias(time)).where(F.col(time).isNotNull())
    return semi_join(df, earliest, [*keys, time]).distinct()


def keep_groups_any(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """All rows of every group in which some row meets the condition."""
    return semi_join(df, df.where(condition).select(*keys), list(keys))
