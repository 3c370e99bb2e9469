"""Life-history reconstruction of tagged individuals observed in repeated censuses.

A panel has one row per sighting: plot, tag, year, status and descriptive columns. Missing
sightings are implied by later ones; these operators add the implied rows, correct
contradicted statuses, and derive cohorts, survival and establishment from the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from plotfield.functions.missing import count_distinct_with_missing, is_in, not_in, strict
from plotfield.functions.recode import cols_with_prefix, density, overwrite_when
from plotfield.operators.groups import earliest_rows, first_seen
from plotfield.operators.joins import complete, left_join, member_flag, semi_join
from plotfield.operators.reshape import longer
from plotfield.operators.summarise import mean_se
from plotfield.session import settle


@dataclass(frozen=True)
class Panel:
    """Column names and status words of a panel."""

    plot: str = "Plot"
    tag: str = "Tag"
    year: str = "Year"
    status: str = "Status"
    species: str = "Species"
    type: str = "Type"
    notes: str = "Notes"
    alive: str = "alive"
    dead: str = "dead"

    def at(self, year: int) -> Column:
        return F.col(self.year) == year

    @property
    def is_dead(self) -> Column:
        return F.col(self.status) == self.dead

    @property
    def is_alive(self) -> Column:
        return F.col(self.status) == self.alive


def _with_copies(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """All rows, and a changed copy beside each that meets the condition; the source is read once."""
    own = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    copy = F.struct(*[(changes[f.name].cast(f.dataType) if f.name in changes else F.col(f"`{f.name}`")).alias(f.name)
                      for f in df.schema])
    rows = F.when(F.coalesce(condition, F.lit(False)), F.array(own, copy)).otherwise(F.array(own))
    return df.select(F.explode(rows).alias("__row")).select("__row.*")


def backfill_prior(
    df: DataFrame, year: int, new_notes: Sequence[Any], panel: Panel = Panel()
) -> DataFrame:
    """Individuals seen in ``year`` and not noted as new were alive the year before.

    A missing note does not mean new, so those rows are projected back as well.
    """
    status = F.when(F.coalesce(panel.is_dead, F.lit(False)), F.lit(panel.alive)).otherwise(F.col(panel.status))
    return _with_copies(df, panel.at(year) & not_in(panel.notes, new_notes),
                        {panel.year: F.lit(year - 1), panel.status: status})


def _dead_at(df: DataFrame, year: int, panel: Panel) -> DataFrame:
    return df.where(panel.at(year) & panel.is_dead)


def backfill_skipped(
    df: DataFrame, year: int, panel: Panel = Panel(), keys: Sequence[str] | None = None
) -> DataFrame:
    """Individuals dead in ``year`` without a row the year before get one, alive."""
    keys = list(keys or (panel.plot, panel.tag, panel.species, panel.type))
    flagged = member_flag(df, df.where(panel.at(year - 1)), keys, "__seen")
    missed = panel.at(year) & panel.is_dead & ~F.col("__seen")
    return _with_copies(flagged, missed, {
        panel.year: F.lit(year - 1), panel.status: F.lit(panel.alive)}).drop("__seen")


def revive_earlier(
    df: DataFrame, year: int, panel: Panel = Panel(), keys: Sequence[str] | None = None
) -> DataFrame:
    """Rows of the year before become alive if their key is in the dead-at-``year`` set.

    The default key is the tag alone, although tags repeat across plots; pass
    ``keys=(plot, tag)`` for the stricter repair.
    """
    keys = list(keys or (panel.tag,))
    flagged = member_flag(df, _dead_at(df, year, panel), keys, "__revived")
    hit = panel.at(year - 1) & F.col("__revived")
    return overwrite_when(flagged, panel.status, F.coalesce(hit, F.lit(False)),
                          panel.alive).drop("__revived")


def repair(
    df: DataFrame, prior: tuple[int, Sequence[Any]] | None = None, skipped: int | None = None, revived: int | None = None,
    panel: Panel = Panel(), keys: Sequence[str] | None = None, revived_keys: Sequence[str] | None = None,
) -> DataFrame:
    """:func:`backfill_prior` (year, new notes), :func:`backfill_skipped` and :func:`revive_earlier`, in this order, in two reads of the panel.

    The first read reduces each individual (``keys``) to two masks, a bit for each year in which it was seen or is found by the first
    repair, and one for each year in which it was dead. The masks are written; ``revived_keys``, which must be among ``keys``, sum them up
    further. The second read meets the masks in one join, and all three repairs are then decided row by row.
    """
    keys = list(keys or (panel.plot, panel.tag, panel.species, panel.type))
    revived_keys = list(revived_keys or (panel.tag,))
    if not set(revived_keys) <= set(keys):
        raise ValueError("revived_keys must be among keys")
    years = [y for y in (prior and prior[0], skipped, revived) if y is not None]
    if not years:
        return df
    first = min(years) - 1
    if max(years) - first > 62:
        raise ValueError("the years of a repair must lie within 62 years")
    year = F.col(panel.year).cast("int")
    projected = panel.at(prior[0]) & not_in(panel.notes, prior[1]) if prior else F.lit(False)

    def bit(y: int) -> int:
        return 1 << (y - first)

    def has(mask: str, y: int) -> Column:
        return F.col(mask).bitwiseAND(F.lit(bit(y))) != 0

    out = df
    if skipped is not None or revived is not None:
        own = F.when(year.between(first, first + 62), F.expr(f"shiftleft(1L, cast(`{panel.year}` as int) - {first})"))
        marked = df.select(*keys, F.coalesce(own, F.lit(0)).bitwiseOR(F.when(projected, F.lit(bit(prior[0] - 1) if prior else 0)).otherwise(0)).alias("__seen"),
                           F.when(panel.is_dead, own).alias("__dead"))
        masks = settle(marked.groupBy(*keys).agg(F.bit_or("__seen").alias("__seen"), F.coalesce(F.bit_or("__dead"), F.lit(0)).alias("__dead")))
        if revived is not None:
            wider_masks = masks.groupBy(*revived_keys).agg(F.bit_or("__dead").alias("__lost"))
            masks = left_join(masks, wider_masks, revived_keys)
        out = left_join(df, masks.drop("__dead"), keys)
    if prior:
        status = F.when(F.coalesce(panel.is_dead, F.lit(False)), F.lit(panel.alive)).otherwise(F.col(panel.status))
        out = _with_copies(out, projected, {panel.year: F.lit(prior[0] - 1), panel.status: status})
    if skipped is not None:
        out = _with_copies(out, panel.at(skipped) & panel.is_dead & ~has("__seen", skipped - 1),
                           {panel.year: F.lit(skipped - 1), panel.status: F.lit(panel.alive)})
    if revived is not None:
        out = overwrite_when(out, panel.status, F.coalesce(panel.at(revived - 1) & has("__lost", revived), F.lit(False)), panel.alive)
    return out.drop("__seen", "__lost")


def assign_cohort(
    df: DataFrame, years: Sequence[int], new_notes: Sequence[Any], new_tag: Any = None,
    panel: Panel = Panel(), prefix: str = "Cohort_",
) -> DataFrame:
    """Cohort from the first year seen, overridden by the row's year where it is marked new."""
    seen = first_seen(df, [panel.plot, panel.tag], panel.year, "FirstYear")
    by_first = F.when(
        F.col("FirstYear").isin(list(years)),
        F.concat(F.lit(prefix), F.col("FirstYear").cast("int").cast("string")))
    marked = is_in(panel.notes, new_notes)
    if new_tag is not None:
        marked = marked | is_in(panel.tag, [new_tag])
    by_row = F.concat(F.lit(prefix), F.col(panel.year).cast("int").cast("string"))
    return seen.withColumn("Cohort", F.when(marked, by_row).otherwise(by_first))


def cohort_members(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """First record of each individual, exact duplicates dropped."""
    return earliest_rows(df, [panel.plot, panel.tag, panel.species, panel.type], panel.year)


def cohort_counts_complete(
    members: DataFrame, design: DataFrame, kind: str | None = None, panel: Panel = Panel(),
    name: str = "Count",
) -> DataFrame:
    """Members per plot and year on the full design grid, zero where none was found."""
    chosen = members if kind is None else members.where(F.col(panel.type) == kind)
    counts = chosen.groupBy(panel.plot, panel.year).agg(F.count(F.lit(1)).alias(name))
    return complete(design, counts, [panel.plot, panel.year])


def cohort_summary(
    counts: DataFrame, by: Sequence[str], value: str = "Count",
    names: tuple[str, str] = ("Mean_Count", "SE"),
) -> DataFrame:
    """Mean count and standard error per treatment and cohort year."""
    return mean_se(counts, by, value, names=(names[0], "__sd", names[1], "__n")).drop(
        "__sd", "__n")


def survival_history(
    df: DataFrame, base: int, years: Sequence[int], kind: str | None = None,
    panel: Panel = Panel(), carry: Sequence[str] = (), fill: str | None = None,
) -> DataFrame:
    """Roster of the base year with one status column per later year.

    A later status is alive if any of the individual's rows that year is alive, missing if
    none is but some are unknown, dead otherwise. Individuals not seen have no status
    unless ``fill`` gives one. Repeated roster rows stay repeated.
    """
    chosen = panel.at(base) if kind is None else panel.at(base) & (F.col(panel.type) == kind)
    roster = df.where(chosen).select(
        panel.plot, panel.tag, *carry, F.col(panel.status).alias(f"Status_{base}"))
    later = semi_join(df.where(is_in(panel.year, years)), roster, [panel.tag])

    def status_in(year: int) -> Column:
        this = panel.at(year)
        return (
            F.when(F.count_if(this & panel.is_alive) > 0, F.lit(panel.alive))
            .when(F.count_if(this & F.col(panel.status).isNull()) > 0, F.lit(None))
            .when(F.count_if(this) > 0, F.lit(panel.dead))
        )

    names = {y: f"Status_{y}" for y in years}
    wide = later.groupBy(panel.plot, panel.tag).agg(
        *[status_in(y).alias(n) for y, n in names.items()])
    history = left_join(roster, wide, [panel.plot, panel.tag])
    return history if fill is None else history.fillna(fill, subset=list(names.values()))


def survival_rates(
    history: DataFrame, base: int, years: Sequence[int], panel: Panel = Panel()
) -> DataFrame:
    """Share of the whole roster known alive in each later year."""
    n = F.count(F.lit(1))
    out = [n.alias(f"n_{base}")]
    for y in years:
        alive = F.count_if(F.col(f"Status_{y}") == panel.alive)
        out += [alive.alias(f"alive_{y}"), (alive / n).alias(f"surv_rate_{y}")]
    return history.agg(*out)


def status_long(history: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """One row per roster row and year."""
    columns = cols_with_prefix(history, "Status_")
    long = longer(history, cols=columns, names_pattern="Status_(.*)", names_to=[panel.year],
                  value=panel.status)
    return long.withColumn(panel.year, F.col(panel.year).cast("int"))


def transitions(
    history: DataFrame, years: Sequence[int], by: Sequence[str], panel: Panel = Panel()
) -> DataFrame:
    """0/1 survival per individual and later year; repeated roster rows collapse to the best."""
    long = status_long(history, panel).where(F.col(panel.year).isin(list(years)))
    survived = F.when(panel.is_alive, F.lit(1.0)).when(~panel.is_alive, F.lit(0.0))
    return long.groupBy(panel.plot, panel.tag, *by, panel.year).agg(
        strict(F.max(survived), panel.status).alias("Survival"))


def survival_summary(
    moves: DataFrame, by: Sequence[str], panel: Panel = Panel()
) -> DataFrame:
    """Survivors over the number of distinct tags per treatment and year."""
    return moves.groupBy(*by).agg(
        count_distinct_with_missing(panel.tag).alias("n"),
        strict(F.sum("Survival"), "Survival").alias("survived"),
    ).withColumn("survival_rate", F.try_divide("survived", F.col("n").cast("double")))


def survival_by(history: DataFrame, by: Sequence[str], panel: Panel = Panel()) -> DataFrame:
    """Roster rows, rows alive and their share per group and year."""
    return status_long(history, panel).groupBy(*by, panel.year).agg(
        F.count(F.lit(1)).alias("total"),
        strict(F.count_if(panel.is_alive), panel.status).alias("alive"),
    ).withColumn("survival_rate", F.try_divide(F.col("alive").cast("double"),
                                               F.col("total").cast("double")))


def establishment(
    df: DataFrame, design: DataFrame, cover: DataFrame, after: int, subplot: str,
    areas: dict[Any, float], other_area: float, cover_value: str,
    by: Sequence[str], panel: Panel = Panel(),
) -> DataFrame:
    """Distinct tags per plot, year and subplot on the full design, per unit area.

    Every tag seen after the given year counts, not only new ones.
    """
    keys = [panel.plot, panel.year, subplot]
    seen = df.where(F.col(panel.year) > after).groupBy(*keys).agg(
        count_distinct_with_missing(panel.tag).alias("n_seedlings"))
    on_grid = complete(design, seen, keys)
    joined = left_join(on_grid, cover.select(*keys, cover_value), keys)
    per_unit = (
        joined.withColumn("log_cover", F.log1p(F.col(cover_value)))
        .groupBy(*keys, *by, "log_cover")
        .agg(F.sum("n_seedlings").alias("total_seedlings"))
    )
    return per_unit.withColumn(
        "density", density("total_seedlings", subplot, areas, other_area))
