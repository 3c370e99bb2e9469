"""Grouped summaries of designed experiments.

Everything here is partial-then-final aggregation: a hot group is reduced inside each map
task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from plotfield.functions.missing import (
    count_distinct_with_missing, observed, std_error, strict as strictly,
)
from plotfield.functions.text import mean_sd_text
from plotfield.operators.joins import complete, left_join
from plotfield.operators.reshape import longer_values

FUNCTIONS: Mapping[str, Callable[[str], Column]] = {
    "mean": lambda c: F.avg(observed(c)),
    "sd": lambda c: F.stddev_samp(observed(c)),
    "var": lambda c: F.var_samp(observed(c)),
    "min": lambda c: F.min(F.col(c)),
    "max": lambda c: F.max(F.col(c)),
    "sum": lambda c: F.sum(observed(c)),
    "n": lambda c: F.count(F.col(c)),
}


def mean_se(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    n: str = "rows",
    strict: bool = False,
    names: tuple[str, str, str, str] = ("mean", "sd", "se", "n"),
) -> DataFrame:
    """Mean, sample sd, standard error and row count per group.

    ``n`` picks the size in the standard error (all rows or observed values); ``strict``
    makes a group's statistics missing as soon as one value is.
    """
    number = observed(value)  # NaN is a missing value
    mean, sd, se = F.avg(number), F.stddev_samp(number), std_error(number, n)
    if strict:
        mean, sd, se = (strictly(x, number) for x in (mean, sd, se))
    return df.groupBy(*by).agg(
        mean.alias(names[0]), sd.alias(names[1]), se.alias(names[2]),
        F.count(F.lit(1)).alias(names[3]),
    )


def pool_se(df: DataFrame, by: Sequence[str], mean: str, se: str) -> DataFrame:
    """Average group means; pooled standard error sqrt(sum se^2) / k."""
    k = F.count(F.lit(1)).cast("double")
    return df.groupBy(*by).agg(
        strictly(F.avg(mean), mean).alias(mean),
        strictly(F.sqrt(F.sum(F.col(se) * F.col(se))) / k, se).alias(se),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (df if columns is None else df.select(*columns)).distinct()


def summarise_across(
    df: DataFrame, by: Sequence[str], cols: Sequence[str],
    fns: Sequence[str] | Mapping[str, Callable[[str], Column]] = ("mean", "sd"),
    name: str = "{col}_{fn}",
) -> DataFrame:
    """Many columns times many functions in a single aggregation."""
    table = {f: FUNCTIONS[f] for f in fns} if not isinstance(fns, Mapping) else dict(fns)
    return df.groupBy(*by).agg(
        *[fn(c).alias(name.format(col=c, fn=f)) for c in cols for f, fn in table.items()]
    )


def mean_sd_table(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], text: str = "mean_sd"
) -> DataFrame:
    """Publication table: one ``mean ± sd`` text per group and variable."""
    long = longer_values(summarise_across(df, by, cols), ids=by)
    return long.select(*by, "variable", mean_sd_text("mean", "sd").alias(text))


def var_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per variable: observed and missing counts, mean and sample variance."""
    stats = summarise_across(
        df, [], cols,
        {
            "nobs": lambda c: F.count(F.col(c)).cast("double"),
            "missing": lambda c: F.count_if(F.col(c).isNull()).cast("double"),
            "mean": F.avg,
            "variance": F.var_samp,
        },
        name="{col}__{fn}",
    )
    return longer_values(stats, ids=[], sep="__")


def rates(
    df: DataFrame, by: Sequence[str], conditions: Mapping[str, Column], n: str = "n"
) -> DataFrame:
    """Rows, rows meeting each condition, and their share. Missing counts as not met."""
    size = F.count(F.lit(1))
    out = [size.alias(n)]
    for label, condition in conditions.items():
        hits = F.count_if(condition)
        out += [hits.alias(label), (hits / size).alias(f"{label}_rate")]
    return df.groupBy(*by).agg(*out)


def proportion_se(
    df: DataFrame, by: Sequence[str], unit: str, event: Column, cohort_by: Sequence[str],
    cohort: Column | None = None,
) -> DataFrame:
    """Distinct units with the event over a fixed cohort, with binomial standard error.

    The cohort size is the number of distinct units per ``cohort_by`` among the rows that
    satisfy ``cohort`` (all rows if not given).
    A unit that is missing counts as one more unit, in the cohort and among those with the event.
    """
    base = df if cohort is None else df.where(cohort)
    sizes = base.groupBy(*cohort_by).agg(count_distinct_with_missing(unit).alias("n_cohort"))
    met = F.coalesce(event, F.lit(False))
    nameless = F.max((met & F.col(unit).isNull()).cast("long"))
    hits = df.groupBy(*by).agg(
        (F.count_distinct(F.when(met, F.col(unit))) + nameless).alias("survived"))
    share = F.try_divide(F.col("survived").cast("double"), F.col("n_cohort").cast("double"))
    return (
        left_join(hits, sizes, list(cohort_by))
        .withColumn("proportion", share)
        .withColumn(
            "se", F.sqrt(F.try_divide(F.col("proportion") * (1 - F.col("proportion")),
                                      F.col("n_cohort").cast("double")))
        )
    )


def entity_mean(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """One mean per entity and date, across its sensors."""
    return df.groupBy(*by).agg(F.avg(observed(value)).alias(name))


def null_count(df: DataFrame, *cols: str) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def contingency(
    df: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence[Any]] | None = None
) -> DataFrame:
    """Counts for every combination of levels, with zeros; missing values are left out.

    The levels of an axis that ``levels`` does not list are those of the counted table. Each
    axis becomes one array by aggregation and is exploded, so that the combinations arise on
    the executors; a table's axes are small by nature.
    """
    counts = df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).persist()
    known = dict(levels or {})
    axes = counts.agg(*[
        (F.array(*[F.lit(v) for v in known[c]]) if c in known else F.array_sort(F.collect_set(c))).alias(c)
        for c in cols])
    for c in cols:
        axes = axes.withColumn(c, F.explode(c))
    return complete(axes, counts, list(cols), fill=0)


def zscore(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Centre and scale columns by their table-wide mean and sample sd.

    All statistics come from one aggregation, read back as scalar subqueries: no window
    over the whole table and no join.
    """
    stats = df.agg(
        *[F.avg(c).alias(f"{c}__m") for c in cols],
        *[F.stddev_samp(c).alias(f"{c}__s") for c in cols],
    )

    def one(name: str) -> Column:
        return stats.select(F.col(name)).scalar()

    return df.withColumns(
        {c + suffix: F.try_divide(F.col(c) - one(f"{c}__m"), one(f"{c}__s")) for c in cols}
    )
