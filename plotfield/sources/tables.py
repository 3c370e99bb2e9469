"""Tolerant table loading.

Field sheets come with padded headers, byte-order marks, blank lines, ``NA`` markers and
stray text in numeric columns. A declared schema is matched by name and applied with
``try_cast``, so an unreadable cell becomes missing instead of failing the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, NumericType, StringType, StructField, StructType

from plotfield.functions.missing import observed, to_number


def _clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip().lstrip("﻿").strip() for name in df.columns])


def read_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, **options: Any
) -> DataFrame:
    """Delimited (or, by suffix, Parquet/ORC/JSON) scan from any Hadoop-compatible path.

    Without ``schema`` Spark infers types, which costs one more pass over the file.
    """
    stem = str(path).rstrip("/").lower()
    for suffix in ("parquet", "orc", "json"):
        if stem.endswith("." + suffix):
            df = _clean_headers(spark.read.format(suffix).load(path, **options))
            return df if schema is None else _conform(df, schema)
    settings = {"inferSchema": schema is None, **options}
    raw = _clean_headers(
        spark.read.csv(
            path,
            header=True,
            ignoreLeadingWhiteSpace=True,
            ignoreTrailingWhiteSpace=True,
            nullValue="NA",
            **settings,
        )
    )
    return raw if schema is None else _conform(raw, schema)


def _conform(df: DataFrame, schema: StructType | str) -> DataFrame:
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    absent = [f.name for f in wanted if f.name not in df.columns]
    if absent:
        raise ValueError(f"columns not in file: {absent}; found {df.columns}")
    return df.select(
        *[_converted(df, f.name, f.dataType).alias(f.name) for f in wanted]
    )


def _converted(df: DataFrame, name: str, to: DataType) -> Column:
    """A column as the declared type: text that is no number, and NaN, become missing."""
    column = F.col(f"`{name}`")
    if isinstance(to, NumericType) and isinstance(df.schema[name].dataType, StringType):
        return to_number(column, to.simpleString())
    cast = column.try_cast(to)
    return observed(cast) if isinstance(to, (DoubleType, FloatType)) else cast


def read_wide(
    spark: SparkSession, path: str, ids: str | None = None, pattern: str | None = None,
    keep: Callable[[dict[str, str | None]], bool] | None = None, value_type: str = "double", **options: Any,
) -> DataFrame:
    """Wide sheet: one row per timestamp, one column per sensor.

    ``ids`` declares the leading columns, and ``pattern`` says how the whole header of a sensor column reads. Headers are parsed
    when the plan is made; a column stays if ``keep`` accepts the named groups of its header. The file is then scanned for
    the wanted columns alone, without a pass to infer types. Sensor values become ``value_type``; a cell that is none is missing.
    Without a pattern all columns are read, as by :func:`read_table`.
    """
    if pattern is None:
        return read_table(spark, path, ids, **options)
    headers = read_table(spark, path, None, **{**options, "inferSchema": False})
    leading = StructType.fromDDL(ids) if ids else StructType()
    found = {c: re.fullmatch(pattern, c) for c in headers.columns if c not in leading.names}
    wanted = [c for c, match in found.items() if match and (keep is None or keep(match.groupdict()))]
    if not wanted:
        raise ValueError(f"no column of {path} reads as {pattern!r}")
    sensors = StructType.fromDDL(f"v {value_type}")["v"].dataType
    return _conform(headers, StructType([*leading.fields, *[StructField(c, sensors) for c in wanted]]))


def literal_table(
    spark: SparkSession, rows: Sequence[Sequence[Any]], schema: StructType | str
) -> DataFrame:
    """Inline table of rows that the caller holds in memory. Its size is known to the optimizer."""
    fields = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields
    columns = [pa.array([row[i] for row in rows]) for i in range(len(fields))]
    inline = spark.createDataFrame(pa.table(columns, names=[f.name for f in fields]))
    return inline.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
