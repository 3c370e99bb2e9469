"""Two-sample t-test and one-predictor regression, whole or per group.

All sums run as one built-in aggregation; only the finished statistics, one row per group,
meet Python, for the tail probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from plotfield.models._tails import t_quantile, t_two_sided


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_critical(level: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(a, b) if b > 0 else None for a, b in zip(level, df)],
                     dtype="float64")


def welch_t(
    df: DataFrame, value: str, in_first: Column, by: Sequence[str] = (), level: float = 0.95
) -> DataFrame:
    """Unequal-variance t-test of the rows meeting ``in_first`` against those that do not."""
    first, second = F.when(in_first, F.col(value)), F.when(~in_first, F.col(value))
    stats = df.groupBy(*by).agg(
        F.avg(first).alias("mean_1"), F.avg(second).alias("mean_2"),
        F.count(first).cast("double").alias("n_1"), F.count(second).cast("double").alias("n_2"),
        F.var_samp(first).alias("__v1"), F.var_samp(second).alias("__v2"),
    )
    a = F.try_divide(F.col("__v1"), F.col("n_1"))
    b = F.try_divide(F.col("__v2"), F.col("n_2"))
    stats = stats.withColumns({"__a": a, "__b": b}).withColumns({
        "se": F.sqrt(F.col("__a") + F.col("__b")),
        "df": F.try_divide(
            F.pow(F.col("__a") + F.col("__b"), F.lit(2.0)),
            F.col("__a") * F.col("__a") / (F.col("n_1") - 1)
            + F.col("__b") * F.col("__b") / (F.col("n_2") - 1)),
    })
    gap = F.col("mean_1") - F.col("mean_2")
    stats = stats.withColumn("t", F.try_divide(gap, F.col("se")))
    reach = t_critical(F.lit(level), F.col("df")) * F.col("se")
    return stats.select(
        *by, "n_1", "n_2", "mean_1", "mean_2", "t", "df",
        t_p_value("t", "df").alias("p_value"),
        (gap - reach).alias("lower"), (gap + reach).alias("upper"),
    )


def _line(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    pair = df.select(*by, F.col(y).cast("double").alias("__y"), F.col(x).cast("double").alias("__x"))
    sums = pair.dropna(subset=["__y", "__x"]).groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("__x").alias("__xm"), F.avg("__y").alias("__ym"),
        F.regr_sxx("__y", "__x").alias("__sxx"), F.regr_syy("__y", "__x").alias("__syy"),
        F.regr_sxy("__y", "__x").alias("__sxy"),
        F.min("__x").alias("__lo"), F.max("__x").alias("__hi"),
    )
    sums = sums.withColumn("slope", F.try_divide("__sxy", "__sxx"))
    return sums.withColumns({
        "intercept": F.col("__ym") - F.col("slope") * F.col("__xm"),
        "__rss": F.greatest(F.col("__syy") - F.col("slope") * F.col("__sxy"), F.lit(0.0)),
        "df": F.col("n") - 2,
    }).withColumn("sigma", F.sqrt(F.when(F.col("df") > 0, F.col("__rss") / F.col("df"))))


def ols(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Straight-line fit with standard errors, tests and R², one row per group."""
    line = _line(df, y, x, by)
    line = line.withColumns({
        "slope_se": F.try_divide(F.col("sigma"), F.sqrt("__sxx")),
        "intercept_se": F.col("sigma") * F.sqrt(
            1 / F.col("n") + F.try_divide(F.col("__xm") * F.col("__xm"), F.col("__sxx"))),
        "r_squared": 1 - F.try_divide("__rss", "__syy"),
    })
    line = line.withColumns({
        "slope_t": F.try_divide("slope", "slope_se"),
        "intercept_t": F.try_divide("intercept", "intercept_se"),
        "adj_r_squared": 1 - (1 - F.col("r_squared")) * F.try_divide(F.col("n") - 1, F.col("df")),
    })
    return line.select(
        *by, "n", "intercept", "intercept_se", "intercept_t",
        t_p_value("intercept_t", "df").alias("intercept_p"),
        "slope", "slope_se", "slope_t", t_p_value("slope_t", "df").alias("slope_p"),
        "sigma", "df", "r_squared", "adj_r_squared",
        (F.col("slope_t") * F.col("slope_t")).alias("f_value"),
    )


def fit_band(
    df: DataFrame, y: str, x: str, n: int = 80, level: float = 0.95, by: Sequence[str] = ()
) -> DataFrame:
    """Fitted line and its confidence band on ``n`` evenly spaced x values per group."""
    line = _line(df, y, x, by).withColumn("__q", t_critical(F.lit(level), F.col("df")))
    points = line.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    points = points.withColumn(
        "x", F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__i") / F.lit(max(n - 1, 1)))
    away = F.col("x") - F.col("__xm")
    points = points.withColumns({
        "fit": F.col("intercept") + F.col("slope") * F.col("x"),
        "se": F.col("sigma") * F.sqrt(1 / F.col("n") + F.try_divide(away * away, F.col("__sxx"))),
    })
    return points.select(
        *by, "x", "fit", "se",
        (F.col("fit") - F.col("__q") * F.col("se")).alias("lower"),
        (F.col("fit") + F.col("__q") * F.col("se")).alias("upper"),
    )
