"""Wide to long, long to wide, and splitting of text columns.

Column names are parsed at plan time: they become literals, not per-row regex work.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType


def longer(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    ids: Sequence[str] | None = None,
    prefix: str | Sequence[str] | None = None,
    name: str = "name",
    value: str = "value",
    names_pattern: str | None = None,
    names_to: Sequence[str] | None = None,
    value_type: str | None = None,
) -> DataFrame:
    """One row per (id, measured column).

    The measured columns are listed (``cols``), found by ``prefix``, or all but ``ids``.
    With ``names_pattern`` the groups of the pattern become the columns ``names_to``.
    ``value_type`` casts measured columns that do not share a type.
    """
    if cols is None and prefix is not None:
        cols = [c for c in df.columns
                if c.startswith(prefix if isinstance(prefix, str) else tuple(prefix))]
    if cols is None:
        if ids is None:
            raise ValueError("give cols, prefix or ids")
        cols = [c for c in df.columns if c not in set(ids)]
    if ids is None:
        ids = [c for c in df.columns if c not in set(cols)]
    wide = df.select(*[F.col(f"`{c}`") for c in ids],
                     *[F.col(f"`{c}`").try_cast(value_type).alias(c) if value_type
                       else F.col(f"`{c}`") for c in cols])
    if names_pattern is None:
        return wide.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in cols],
                            name, value)
    targets = list(names_to or [])
    pieces = []
    for c in cols:
        match = re.fullmatch(names_pattern, c)
        groups = match.groups() if match else (None,) * len(targets)
        pieces.append(F.struct(
            *[F.lit(g).cast("string").alias(t) for t, g in zip(targets, groups, strict=True)],
            F.col(f"`{c}`").alias(value),
        ))
    return wide.select(
        *[F.col(f"`{c}`") for c in ids], F.explode(F.array(*pieces)).alias("__piece")
    ).select(*[F.col(f"`{c}`") for c in ids], "__piece.*")


def longer_values(
    df: DataFrame, ids: Sequence[str], name: str = "variable", sep: str = "_"
) -> DataFrame:
    """Columns ``<variable><sep><measure>`` to one row per variable, one column per measure.

    The name is split at the last separator. One ``explode`` does it; no pivot is needed.
    """
    measured = [c for c in df.columns if c not in set(ids)]
    split = {c: tuple(c.rsplit(sep, 1)) for c in measured}
    bad = [c for c, parts in split.items() if len(parts) != 2]
    if bad:
        raise ValueError(f"no '{sep}' in {bad}")
    variables = list(dict.fromkeys(v for v, _ in split.values()))
    measures = list(dict.fromkeys(m for _, m in split.values()))
    by_parts = {parts: c for c, parts in split.items()}
    # A measure keeps its type if all its columns share it; different numbers meet as doubles.
    types = {m: {df.schema[c].dataType for c, parts in split.items() if parts[1] == m} for m in measures}
    kinds = {m: next(iter(t)) if len(t) == 1 else "double" if all(isinstance(x, NumericType) for x in t) else "string"
             for m, t in types.items()}

    def piece(variable: str):
        fields = []
        for m in measures:
            column = by_parts.get((variable, m))
            source = F.lit(None) if column is None else F.col(f"`{column}`")
            fields.append(source.cast(kinds[m]).alias(m))
        return F.struct(F.lit(variable).alias(name), *fields)

    return df.select(
        *ids, F.explode(F.array(*[piece(v) for v in variables])).alias("__piece")
    ).select(*ids, "__piece.*")


def separate(df: DataFrame, column: str, into: Sequence[str | None], sep: str) -> DataFrame:
    """Split text into columns; pieces that are not there are missing, ``None`` skips one."""
    parts = F.split(F.col(column), re.escape(sep))
    new = {n: F.get(parts, F.lit(i)) for i, n in enumerate(into) if n is not None}
    return df.withColumns(new).drop(*([] if column in new else [column]))


def wider(
    df: DataFrame,
    ids: Sequence[str],
    name: str,
    value: str,
    values: Sequence[Any] | None = None,
    prefix: str = "",
) -> DataFrame:
    """One column per value of ``name``.

    Rows are first reduced by ids and name, which combines on the map side, and then one row an id holds
    its cells by name. Without ``values`` the names are those found in the data, in order; that takes a pass
    over them. With a list, a row whose name is not in it fails the job. Rows with a missing name get a
    column ``<prefix>NA``, if there are such rows or the list holds ``None``. A cell must have one
    source row; two distinct values in one cell fail the job.
    """
    if values is None:
        found = df.agg(F.array_sort(F.collect_set(name)), F.bool_or(F.col(f"`{name}`").isNull())).first()
        values = [*found[0], *([None] if found[1] else [])]
    columns = {v: f"{prefix}{'NA' if v is None else v}" for v in values}
    if len(set(columns.values())) < len(columns):
        raise ValueError(f"{name} has missing values and the value 'NA', or two values of one text: {list(values)}")
    kind = df.schema[name].dataType
    names = F.col("__name")
    clash = F.raise_error(F.lit(f"several values of {value} in one cell"))
    unlisted = F.raise_error(F.concat(F.lit(f"{name} has a value that is not listed: "), F.coalesce(names.cast("string"), F.lit("missing"))))
    known = F.coalesce(names.isin([v for v in columns if v is not None]), F.lit(None in columns))
    cells = (df.select(*[F.col(f"`{c}`") for c in ids], F.col(f"`{name}`").alias("__name"), F.col(f"`{value}`").alias("__value"))
             .groupBy(*ids, "__name").agg(F.min("__value").alias("__low"), F.max("__value").alias("__high"))
             .withColumn("__cell", F.when(~known, unlisted).when(F.col("__low").eqNullSafe(F.col("__high")), F.col("__low")).otherwise(clash)))
    wide = cells.groupBy(*ids).agg(
        F.map_from_entries(F.collect_list(F.when(names.isNotNull(), F.struct(names, "__cell")))).alias("__cells"),
        F.max(F.when(names.isNull(), F.col("__cell"))).alias("__unnamed"))
    return wide.select(*[F.col(f"`{c}`") for c in ids], *[
        (F.col("__unnamed") if v is None else F.try_element_at("__cells", F.lit(v).cast(kind))).alias(c) for v, c in columns.items()])
