"""Dates, water years and explicitly bounded seasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from plotfield.functions.missing import _column
from plotfield.functions.recode import _cases


def as_date(c: Column | str) -> Column:
    return F.to_date(_column(c))


def water_year(c: Column | str, first_month: int = 10) -> Column:
    """Calendar year, counted one up from ``first_month`` on."""
    column = _column(c)
    return F.year(column) + (F.month(column) >= first_month).cast("int")


def season(c: Column | str, ranges: Sequence[tuple[str, str, str]]) -> Column:
    """Label from half-open ``[start, end)`` date ranges; missing outside all of them."""
    day = as_date(c)
    return _cases(
        [
            ((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date")), label)
            for start, end, label in ranges
        ],
        None,
    )
