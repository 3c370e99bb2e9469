"""Missing-value rules that differ from SQL defaults."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_in(c: Column | str, values: Iterable[Any]) -> Column:
    """Membership that is false, never missing, for a missing value."""
    return F.coalesce(_column(c).isin(list(values)), F.lit(False))


def not_in(c: Column | str, values: Iterable[Any]) -> Column:
    """Complement of :func:`is_in`: a missing value is not a member, so it is kept."""
    return ~is_in(c, values)


def any3(condition: Column) -> Column:
    """Aggregate: true if any row is true; missing if none is true but some are missing."""
    return (
        F.when(F.coalesce(F.bool_or(condition), F.lit(False)), F.lit(True))
        .when(F.count_if(condition.isNull()) > 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )


def strict(aggregate: Column, c: Column | str) -> Column:
    """Aggregate that is missing as soon as one input is missing."""
    return F.when(F.count(_column(c)) == F.count(F.lit(1)), aggregate)


def std_error(c: Column | str, n: str = "rows") -> Column:
    """Standard error; ``n='rows'`` divides by all rows, ``'nonnull'`` by observed ones."""
    if n not in ("rows", "nonnull"):
        raise ValueError("n is 'rows' or 'nonnull'")
    size = F.count(F.lit(1)) if n == "rows" else F.count(_column(c))
    return F.stddev_samp(_column(c)) / F.sqrt(size.cast("double"))


def count_distinct_with_missing(c: Column | str) -> Column:
    """Distinct count in which missing is one more value."""
    column = _column(c)
    return F.count_distinct(column) + F.max(column.isNull().cast("long"))


#: A decimal number with optional sign, fraction and exponent, and blanks around it.
DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(c: Column | str, to: str = "double") -> Column:
    """Numeric value, or missing where the text is not a number.

    Casts alone also read ``12D``, ``12f``, ``NaN`` and ``Infinity``, which are no measurements.
    """
    text = _column(c).cast("string")
    return F.when(text.rlike(DECIMAL), F.trim(text).try_cast(to))


def observed(c: Column | str) -> Column:
    """The number, or missing where it is NaN."""
    column = _column(c)
    return F.when(~F.isnan(column.cast("double")), column)
