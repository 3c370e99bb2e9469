"""The experiment's layout: which plot has which treatment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotfield.functions import band, parity
from plotfield.operators import grid

# Plot numbers of the burn classes, and how rain treatment follows parity.
BURN_BANDS = [(1, 12, "Moderate_Burn"), (13, 24, "Severe_Burn"), (25, 36, "Unburned")]
ODD_PLOTS, EVEN_PLOTS = "Drought", "Ambient"
BURNED_PLOTS = range(1, 25)
# Survey names of the burn classes.
BURN_NAMES = {"BurnedInvaded": "Moderate_Burn", "BurnedNative": "Severe_Burn"}
BURN_ORDER = ["Moderate_Burn", "Severe_Burn", "Unburned"]


def with_burn(df: DataFrame, plot: str = "Plot") -> DataFrame:
    return df.withColumn("BurnTreat", band(plot, BURN_BANDS))


def with_treatments(df: DataFrame, plot: str = "Plot") -> DataFrame:
    return with_burn(df, plot).withColumn("Drought", parity(plot, ODD_PLOTS, EVEN_PLOTS))


def burned_design(spark: SparkSession, **dimensions) -> DataFrame:
    """All burned plots crossed with the given dimensions, with their treatments."""
    return with_treatments(grid(spark, {"Plot": BURNED_PLOTS, **dimensions}))
