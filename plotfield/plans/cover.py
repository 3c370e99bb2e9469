"""Evergreen cover by year, burn class and rain treatment."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from plotfield.functions import interaction_key, label_pairs
from plotfield.models import crossed, linear_model
from plotfield.operators import (
    arrange, distinct_rows, inner_join, longer, mean_se, null_count, pool_se, wider,
)

MEASURES = ["evergreen_cover", "plot_area", "percent_cover"]
# Published treatment labels.
LABELS = {
    ("BurnedInvaded", "Ambient"): "Moderate Burn Ambient",
    ("BurnedInvaded", "Drought"): "Moderate Burn Drought",
    ("BurnedNative", "Ambient"): "Severe Burn Ambient",
    ("BurnedNative", "Drought"): "Severe Burn Drought",
    ("Unburned", "Ambient"): "Unburned Ambient",
    ("Unburned", "Drought"): "Unburned Drought",
}


def cover_long(cover_wide: DataFrame, treatments: DataFrame) -> DataFrame:
    """One row per plot and year with the three measures as columns."""
    wide = cover_wide.withColumnRenamed("plot", "Plot")
    per_plot = distinct_rows(inner_join(treatments, wide, "Plot").drop("Exclosure"))
    long = longer(per_plot, prefix=MEASURES, names_pattern="(.*)_(.*)",
                  names_to=["Measurement", "Year"], value_type="double")
    return wider(long, ["Plot", "BurnTreat", "Drought", "Year"], "Measurement", "value", MEASURES)


def cover_study(cover_wide: DataFrame, treatments: DataFrame) -> dict[str, Any]:
    long = cover_long(cover_wide, treatments)
    model = linear_model(long, "percent_cover", crossed("BurnTreat", "Year", "Drought"))
    summary = mean_se(
        long, ["BurnTreat", "Drought", "Year"], "percent_cover",
        names=("MeanPercentCover", "SDPercentCover", "SEPercentCover", "n"))
    pooled = pool_se(summary, ["Year", "BurnTreat"], "MeanPercentCover", "SEPercentCover")
    return {
        "long": long,
        "missing_plots": null_count(long, "Plot"),
        "anova": model.anova(type=3),
        "marginal_means": model.emmeans(["BurnTreat", "Year"]),
        "contrasts": model.pairwise(["BurnTreat", "Year"]),
        "summary": arrange(
            summary.withColumns({"TreatmentLabel": label_pairs("BurnTreat", "Drought", LABELS),
                                 "Group": interaction_key("BurnTreat", "Drought")}),
            "BurnTreat", "Drought", "Year"),
        "pooled": arrange(pooled, "Year", "BurnTreat"),
        "model": model,
    }
