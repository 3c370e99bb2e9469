"""Recoding of values, key bands, parity splits, and factors with a declared level order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from plotfield.functions.missing import _column

KEEP = object()
NUMBER_PATTERN = r"^-?\d*(\.\d+)?$"


def _cases(pairs: Sequence[tuple[Column, Any]], default: Any) -> Column:
    if not pairs:
        raise ValueError("at least one case is needed")
    result = F
    for condition, value in pairs:
        result = result.when(condition, value if isinstance(value, Column) else F.lit(value))
    if default is None:
        return result
    return result.otherwise(default if isinstance(default, Column) else F.lit(default))


def recode(c: Column | str, mapping: Mapping[Any, Any], default: Any = KEEP) -> Column:
    """Replace listed values; others stay as they are, or become ``default``."""
    column = _column(c)
    rest = column if default is KEEP else default
    return _cases([(column == F.lit(k), v) for k, v in mapping.items()], rest)


def band(c: Column | str, bands: Sequence[tuple[Any, Any, Any]], default: Any = None) -> Column:
    """Class of a numeric key from inclusive ``(low, high, label)`` bands."""
    column = _column(c)
    return _cases([(column.between(lo, hi), label) for lo, hi, label in bands], default)


def parity(c: Column | str, odd: Any, even: Any) -> Column:
    remainder = F.pmod(_column(c), F.lit(2))
    return F.when(remainder == 1, F.lit(odd)).when(remainder == 0, F.lit(even))


def label_pairs(
    first: Column | str, second: Column | str, mapping: Mapping[tuple[Any, Any], Any],
    default: Any = None,
) -> Column:
    a, b = _column(first), _column(second)
    return _cases(
        [((a == F.lit(x)) & (b == F.lit(y)), label) for (x, y), label in mapping.items()], default
    )


def overwrite_when(df: DataFrame, name: str, condition: Column, value: Any) -> DataFrame:
    """Set ``name`` where the condition holds. A missing condition gives a missing value."""
    new = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(name, F.when(condition, new).when(~condition, F.col(name)))


def lookup(c: Column | str, mapping: Mapping[Any, Any]) -> Column:
    """Named-value lookup; unknown or missing keys give missing."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), _column(c))


def with_levels(df: DataFrame, name: str, levels: Sequence[Any]) -> DataFrame:
    """Restrict a column to its declared levels (others become missing) and record them."""
    column = F.when(F.col(name).isin(list(levels)), F.col(name))
    return df.withColumn(name, column).withMetadata(name, {"levels": [str(x) for x in levels]})


def level_rank(c: Column | str, levels: Sequence[Any]) -> Column:
    """1-based position in the declared order, for sorting; missing outside it."""
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), _column(c))
    return F.when(position > 0, position.cast("int"))


def levels(df: DataFrame, name: str) -> DataFrame:
    """Observed levels of a column, sorted."""
    return df.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name)


def not_numeric_text(c: Column | str) -> Column:
    """True for text that is not a plain number."""
    return ~_column(c).cast("string").rlike(NUMBER_PATTERN)


def non_numeric(df: DataFrame, name: str) -> DataFrame:
    """Distinct values of a column that do not read as numbers."""
    return df.select(name).where(not_numeric_text(name)).distinct()


def cols_with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def with_error_bounds(
    df: DataFrame, mean: str, se: str, lower: str = "lower", upper: str = "upper"
) -> DataFrame:
    return df.withColumns({lower: F.col(mean) - F.col(se), upper: F.col(mean) + F.col(se)})


def density(count: Column | str, subplot: Column | str, areas: Mapping[Any, float],
            otherwise: float) -> Column:
    """Count per area, the area being chosen by the subplot code."""
    return F.try_divide(
        _column(count).cast("double"), recode(subplot, areas, default=F.lit(otherwise))
    )
