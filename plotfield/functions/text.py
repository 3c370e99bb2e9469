"""Labels and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotfield.functions.missing import _column, to_number


def paste(*columns: Column | str, sep: str = " ") -> Column:
    """Join as text; a missing part shows as ``NA``."""
    parts = [F.coalesce(_column(c).cast("string"), F.lit("NA")) for c in columns]
    return F.concat_ws(sep, *parts)


def interaction_key(*columns: Column | str, sep: str = ".") -> Column:
    """Combined level ``a.b.c``; missing if any part is."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(sep), _column(c).cast("string")]
    return F.concat(*parts[1:])


def mean_sd_text(mean: Column | str, sd: Column | str) -> Column:
    """``1.23 ± 0.45``; a missing part shows as ``NA``."""
    def two_digits(c: Column | str) -> Column:
        value = _column(c).cast("double")
        return F.when(value.isNull(), F.lit("NA")).otherwise(F.format_string("%.2f", value))

    return F.concat(two_digits(mean), F.lit(" ± "), two_digits(sd))


def remove_first(c: Column | str, pattern: str) -> Column:
    """Delete the first match only. ``pattern`` must not hold capture groups."""
    return F.regexp_replace(_column(c), f"(?s)^(.*?)(?:{pattern})(.*)$", "$1$2")


def underscores_to_spaces(c: Column | str) -> Column:
    return F.regexp_replace(_column(c), "_", " ")


def parse_subplot(
    df: DataFrame, code: str, suffixes: str, marker: str, yes: str, no: str,
    plot: str = "Plot", subplot: str = "Exclosure", anchored: bool = False,
) -> DataFrame:
    """Split a code such as ``12E`` into plot number 12 and a subplot label.

    ``suffixes`` are the letters to strip, ``marker`` the one that means ``yes``;
    ``anchored`` asks for it at the end of the code.
    """
    found = F.col(code).endswith(marker) if anchored else F.col(code).contains(marker)
    return df.withColumns(
        {
            subplot: F.when(found, F.lit(yes)).when(~found, F.lit(no)),
            plot: to_number(remove_first(code, f"[{suffixes}]"), "int"),
        }
    )
