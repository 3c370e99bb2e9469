"""Soil moisture: wide sensor sheets to dates, seasons and water years."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from plotfield.functions import as_date, interaction_key, non_numeric, season, to_number, water_year
from plotfield.models import crossed, linear_model
from plotfield.operators import arrange, box_stats, entity_mean, longer, mean_se, separate
from plotfield.plans.experiment import with_treatments

# Rainy-season bounds, start included, end not.
SEASONS = [("2022-04-01", "2023-05-01", "2022-2023"), ("2023-05-01", "2024-04-30", "2023-2024")]
PROFILE = "profile"


def moisture_long(sheet: DataFrame, time: str = "UTCdate") -> DataFrame:
    """Columns ``VWC_<plot>_<depth>`` (or ``VWC_<plot>`` for a whole profile) to rows."""
    long = longer(sheet, ids=[time], name="sensor", value="VWC")
    split = separate(long, "sensor", [None, "Plot", "Depth"], "_")
    return with_treatments(split.withColumn("Plot", to_number("Plot", "int"))).withColumns(
        {time: as_date(time), "Depth": F.coalesce("Depth", F.lit(PROFILE))})


def moisture_study(sheet: DataFrame, time: str = "UTCdate") -> dict[str, Any]:
    long = moisture_long(sheet, time)
    observed = long.where(F.col("VWC").isNotNull())
    treatments = ["BurnTreat", "Drought"]
    names = ("Mean_VWC", "__sd", "SE_VWC", "__n")

    def summary(df: DataFrame, by: list[str], n: str = "rows") -> DataFrame:
        stats = mean_se(df, by, "VWC", n=n, names=names).drop("__sd", "__n")
        return arrange(stats.withColumn("Treatment", interaction_key(*treatments)), *by)

    by_season = observed.withColumn("Water_Year", season(time, SEASONS)).where(
        F.col("Water_Year").isNotNull())
    by_year = observed.withColumn("Year", F.year(time))
    daily = entity_mean(long, [time, "Plot", *treatments], "VWC", "VWC_profile").withColumn(
        "Water_Year", water_year(time))
    model = linear_model(daily, "VWC_profile", crossed(*treatments, "Water_Year"),
                         covariates=["Water_Year"])
    in_water_years = long.withColumn("Water_Year", water_year(time))
    return {
        "long": long,
        "unreadable": non_numeric(long, "VWC"),
        "daily": summary(long, [time, *treatments, "Depth"]),
        "yearly": summary(by_year, ["Year", *treatments, "Depth"], n="nonnull"),
        "seasonal": summary(by_season, ["Water_Year", *treatments, "Depth"]),
        "plot_means": daily,
        "anova": model.anova(type=3),
        "box_readings": box_stats(in_water_years, ["Water_Year", *treatments], "VWC"),
        "box_profiles": box_stats(in_water_years.where(F.col("Depth") == PROFILE),
                                  ["Water_Year", *treatments], "VWC"),
        "box_plot_means": box_stats(daily, ["Water_Year", *treatments], "VWC_profile"),
        "model": model,
    }
