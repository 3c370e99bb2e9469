"""Tagged shrubs: panel reconstruction, cohorts, survival and establishment."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from plotfield.functions import level_rank, parse_subplot, paste, recode, underscores_to_spaces
from plotfield.models import crossed, glm_quasipoisson, glmm_binomial, linear_model, terms
from plotfield.operators import (
    add_baseline, arrange, contingency, distinct_rows, duplicate_keys, left_join, mean_se, panel,
    proportion_se, semi_join, union_fill, zscore,
)
from plotfield.operators.joins import grid
from plotfield.session import settle
from plotfield.plans.experiment import BURN_NAMES, BURNED_PLOTS, burned_design, with_treatments

# Field names of two species and their scientific abbreviations, and the
# notes that mark a new plant.
SPECIES = {"DW": "AG", "YS": "EC"}
NEW_NOTES, NEW_TAG = ["new", "new_large"], "new"
YEARS, BASE, LATER = [2022, 2023, 2024], 2022, [2023, 2024]
SEEDLING = "seedling"
# Subplot areas in square metres.
EXCLOSURE_AREA, OPEN_AREA = {"yes": 0.5}, 9.0
BAR_ORDER = [f"{burn}_{fence}_{year}" for fence in ("no", "yes") for year in LATER
             for burn in ("Moderate_Burn", "Severe_Burn")]


def reconstruct(shrubs: DataFrame, treatments: DataFrame) -> dict[str, DataFrame]:
    """Clean the sightings and add the rows that later sightings imply."""
    lookup = treatments.drop("Exclosure").withColumn("BurnTreat", recode("BurnTreat", BURN_NAMES))
    unique = distinct_rows(lookup, ["Plot", "BurnTreat"])
    clean = left_join(shrubs, unique, "Plot").withColumn("Species", recode("Species", SPECIES))
    clean = clean.fillna("no", ["Exclosure"])
    history = panel.repair(clean, prior=(2023, NEW_NOTES), skipped=2024, revived=2024)
    # Every later study reads the panel several times: write it once.
    return {"lookup_duplicates": duplicate_keys(lookup, ["Plot"]), "clean": clean,
            "panel": settle(history)}


def cohort_study(history: DataFrame) -> dict[str, Any]:
    """Cohorts per plot and year, and the counts model."""
    members = panel.cohort_members(panel.assign_cohort(history, YEARS, NEW_NOTES, NEW_TAG))
    design = burned_design(history.sparkSession, Year=YEARS)
    counts = panel.cohort_counts_complete(members, design, SEEDLING)
    display = panel.cohort_summary(
        counts.withColumn("Cohort", F.concat(F.lit("Cohort_"), F.col("Year").cast("string"))),
        ["BurnTreat", "Cohort"])
    display = add_baseline(
        display, [("Unburned", f"Cohort_{y}", 0.0, 0.0) for y in YEARS],
        ["BurnTreat", "Cohort", "Mean_Count", "SE"])
    model = glm_quasipoisson(counts, "Count", crossed("Year", "Drought", "BurnTreat"))
    return {
        "members": members,
        "cohort_sizes": members.groupBy("Cohort").agg(F.count(F.lit(1)).alias("n")),
        "per_plot": members.where(F.col("Type") == SEEDLING).groupBy("Plot").agg(
            F.count(F.lit(1)).alias("n_seedlings")),
        "counts": counts,
        "display": display.withColumn("BurnTreat", underscores_to_spaces("BurnTreat")),
        "anova": model.anova(type=3),
        "year_means": model.emmeans(["Year"]),
        "year_contrasts": model.pairwise(["Year"]),
        "model": model,
    }


def survival_study(history: DataFrame) -> dict[str, Any]:
    """Fate of the base-year seedlings."""
    roster = panel.survival_history(history, BASE, LATER, SEEDLING)
    filled = roster.fillna("dead", [f"Status_{y}" for y in LATER])
    moves = panel.transitions(with_treatments(filled), LATER, ["BurnTreat", "Drought"])
    shares = proportion_se(moves, ["BurnTreat", "Year"], "Tag", F.col("Survival") == 1,
                           ["BurnTreat"], cohort=F.col("Year") == LATER[0])
    shares = shares.select("BurnTreat", F.col("Year").alias("NextYear"),
                           F.col("proportion").alias("Mean_Count"), F.col("se").alias("SE"))
    shares = add_baseline(shares, [("Unburned", y, 0.0, 0.0) for y in LATER],
                          ["BurnTreat", "NextYear", "Mean_Count", "SE"])
    model = glmm_binomial(moves, "Survival", crossed("BurnTreat", "Drought", "Year"), "Plot")
    return {
        "history": roster,
        "rates": panel.survival_rates(roster, BASE, LATER),
        "transitions": moves,
        "summary": panel.survival_summary(moves, ["BurnTreat", "Drought", "Year"]),
        "display": shares,
        "coefficients": model.coefficients(),
        "anova": model.anova(type=3),
        "model": model,
    }


def invasive_cover_long(sheets: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    """Cover sheets of several years, plot codes such as ``12H`` split."""
    parsed = [
        parse_subplot(sheet.withColumnRenamed("plot", "code"), "code", "H", "H", "yes", "no",
                      anchored=True)
        .select("Plot", "Exclosure", "invasive_cover").withColumn("Year", F.lit(year))
        for year, sheet in sheets
    ]
    return union_fill(*parsed)


def subplot_survival_study(history: DataFrame, cover: DataFrame) -> dict[str, Any]:
    """Survival inside and outside exclosures, with invasive cover as covariate."""
    roster = panel.survival_history(history, BASE, LATER, SEEDLING, carry=["Exclosure"],
                                    fill="dead")
    long = panel.status_long(roster)
    started = long.where((F.col("Year") == BASE) & (F.col("Status") == "alive"))
    kept = semi_join(long, started, ["Tag"]).where(F.col("Exclosure").isNotNull())
    kept = left_join(kept, cover, ["Plot", "Exclosure", "Year"]).where(F.col("Year") != BASE)
    kept = with_treatments(kept).withColumns({
        "Survival": F.when(F.col("Status") == "alive", 1.0).otherwise(0.0),
        "invasive_cover_scaled": F.log1p("invasive_cover"),
    })
    kept = zscore(kept, ["invasive_cover_scaled"])
    model = glmm_binomial(
        kept, "Survival",
        terms(crossed("BurnTreat", "Exclosure"), "Drought", crossed("Year", "Exclosure"),
              "invasive_cover"),
        "Plot", covariates=["invasive_cover"], contrasts="sum")
    summary = mean_se(kept, ["Year", "BurnTreat", "Exclosure"], "Survival", strict=True,
                      names=("mean_survival", "__sd", "SE", "n_seedlings")).drop("__sd")
    summary = summary.withColumn("bar_group", paste("BurnTreat", "Exclosure", "Year", sep="_"))
    return {
        "by_plot": panel.survival_by(roster, ["Plot", "Exclosure"]),
        "rows": kept,
        "cells": contingency(kept, ["BurnTreat", "Exclosure", "Year"]),
        "outcome_cells": contingency(kept, ["BurnTreat", "Exclosure", "Survival"]),
        "summary": arrange(summary, level_rank("bar_group", BAR_ORDER)),
        "coefficients": model.coefficients(),
        "anova": model.anova(type=3),
        "model": model,
    }


def establishment_study(history: DataFrame, cover: DataFrame) -> dict[str, Any]:
    """Seedling density per subplot, adjusted for invasive cover."""
    design = with_treatments(grid(history.sparkSession, {
        "Plot": BURNED_PLOTS, "Year": LATER, "Exclosure": ["no", "yes"]}))
    density = panel.establishment(
        history, design, cover, BASE, "Exclosure", EXCLOSURE_AREA, OPEN_AREA, "invasive_cover",
        ["BurnTreat", "Drought"])
    model = linear_model(
        density, "density", terms(crossed("Year", "BurnTreat", "Exclosure", "Drought"), "log_cover"),
        covariates=["log_cover"])
    summary = mean_se(density, ["Year", "BurnTreat", "Exclosure"], "density", strict=True,
                      names=("mean_density", "sd", "SE", "n"))
    summary = summary.withColumn("bar_group", paste("BurnTreat", "Exclosure", "Year", sep="_"))
    return {
        "density": density,
        "anova": model.anova(type=2),
        "summary": arrange(summary, level_rank("bar_group", BAR_ORDER)),
        "model": model,
    }
