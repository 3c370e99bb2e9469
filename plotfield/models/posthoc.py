"""Marginal means and adjusted pairwise contrasts from any fitted coefficient vector."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from plotfield.models._tables import table
from plotfield.models._tails import studentised_range_upper, t_quantile, t_two_sided
from plotfield.models.design import Design


def _grid(design: Design, over: Sequence[str], at: Mapping[str, float]):
    missing = [f for f in over if f not in design.levels]
    if missing:
        raise ValueError(f"not factors of the model: {missing}")
    return design.means_over(over, at)


def emmeans_table(
    spark: SparkSession, design: Design, over: Sequence[str], at: Mapping[str, float],
    beta: np.ndarray, cov: np.ndarray, df_of: Callable[[np.ndarray], float], level: float = 0.95,
) -> DataFrame:
    """Equal-weight marginal means with confidence limits."""
    names, rows = _grid(design, over, at)
    out = []
    for name, row in zip(names, rows):
        mean, se, df = row @ beta, math.sqrt(max(row @ cov @ row, 0.0)), df_of(row)
        reach = t_quantile(level, df) * se
        out.append((*name, mean, se, df, mean - reach, mean + reach))
    ddl = ", ".join(f"`{f}` string" for f in over)
    return table(spark, out,
                 f"{ddl}, emmean double, se double, df double, lower double, upper double")


def pairwise_table(
    spark: SparkSession, design: Design, over: Sequence[str], at: Mapping[str, float],
    beta: np.ndarray, cov: np.ndarray, df_of: Callable[[np.ndarray], float],
    adjust: str = "tukey",
) -> DataFrame:
    """Differences of all pairs of marginal means, Tukey-adjusted or unadjusted."""
    if adjust not in ("tukey", "none"):
        raise ValueError("adjust is 'tukey' or 'none'")
    names, rows = _grid(design, over, at)
    out = []
    for i, j in combinations(range(len(names)), 2):
        row = rows[i] - rows[j]
        gap, se, df = row @ beta, math.sqrt(max(row @ cov @ row, 0.0)), df_of(row)
        t = gap / se if se > 0 else math.copysign(math.inf, gap) if gap else math.nan
        p = (studentised_range_upper(abs(t) * math.sqrt(2.0), len(names), df)
             if adjust == "tukey" else t_two_sided(t, df))
        out.append((" ".join(names[i]) + " - " + " ".join(names[j]), gap, se, df, t, p))
    return table(
        spark, out,
        "contrast string, estimate double, se double, df double, t_ratio double, p_value double")
