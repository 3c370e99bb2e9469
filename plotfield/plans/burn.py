"""Burn intensity: twig diameters by burn class, and against aspect or slope."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from plotfield.functions import recode
from plotfield.models import fit_band, ols, welch_t
from plotfield.operators import arrange, box_outliers, box_stats, inner_join

# Field codes of the burn classes.
FIELD_CODES = {"burneda": "BurnedInvaded", "burnedb": "BurnedNative"}


def burn_intensity(twigs: DataFrame) -> dict[str, DataFrame]:
    """``twigs``: plot, treatment, diameter."""
    named = twigs.withColumn("treatment", recode("treatment", FIELD_CODES))
    return {
        "t_test": welch_t(named, "diameter", F.col("treatment") == "BurnedInvaded"),
        "box": arrange(box_stats(named, ["treatment"], "diameter"), "treatment"),
        "outliers": box_outliers(named, ["treatment"], "diameter"),
    }


def diameter_against(twigs: DataFrame, terrain: DataFrame, measure: str) -> dict[str, Any]:
    """Twig diameter against a terrain measure; plots without both are left out."""
    joined = inner_join(terrain.select("plot", measure), twigs, "plot")
    return {
        "joined": joined,
        "regression": ols(joined, "diameter", measure),
        "band": fit_band(joined, "diameter", measure),
        "box": arrange(box_stats(twigs, ["treatment"], "diameter"), "treatment"),
    }
