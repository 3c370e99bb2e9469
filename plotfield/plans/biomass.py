"""Live biomass by burn class, subplot and rain treatment, in two years."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from plotfield.functions import interaction_key, parse_subplot
from plotfield.models import crossed, linear_model, lmm
from plotfield.operators import arrange, longer, mean_se, union_fill
from plotfield.plans.experiment import with_treatments

INSIDE, OUTSIDE = "Enclosed", "Not Enclosed"


def from_wide_sheet(sheet: DataFrame, plot: str, year: str) -> DataFrame:
    """Sheet with one biomass column per subplot kind."""
    long = longer(sheet, cols=[INSIDE, OUTSIDE], name="Exclosure", value="Biomass")
    named = long.withColumnRenamed(plot, "Plot").withColumn("Plot", F.col("Plot").cast("int"))
    return with_treatments(named).withColumn("Year", F.lit(year))


def from_coded_sheet(sheet: DataFrame, plot: str, year: str) -> DataFrame:
    """Sheet with plot codes such as ``12E`` and the live weight in its own column."""
    parsed = parse_subplot(sheet, plot, "OE", "E", INSIDE, OUTSIDE)
    live = parsed.select("Plot", "Exclosure", F.col("Live").alias("Biomass"))
    return with_treatments(live).withColumn("Year", F.lit(year))


def biomass_study(sheet_2024: DataFrame, sheet_2023: DataFrame) -> dict[str, Any]:
    second = from_wide_sheet(sheet_2024, "Plot #", "2024")
    first = from_coded_sheet(sheet_2023, "Plot", "2023")
    both = union_fill(first, second)
    model_2024 = linear_model(second, "Biomass", crossed("BurnTreat", "Drought", "Exclosure"))
    model_2023 = linear_model(first, "Biomass", crossed("BurnTreat", "Exclosure", "Drought"))
    names = ("Mean_Biomass", "__sd", "SE_Biomass", "__n")
    summary = mean_se(both, ["Year", "BurnTreat", "Exclosure"], "Biomass", names=names).drop(
        "__sd", "__n")
    three_way = lmm(both, "Biomass", crossed("BurnTreat", "Exclosure", "Year"), "Plot")
    four_way = lmm(both, "Biomass", crossed("BurnTreat", "Exclosure", "Year", "Drought"), "Plot",
                   contrasts="sum")
    return {
        "long": both,
        "anova_2024": model_2024.anova(type=1),
        "tukey_2024": model_2024.tukey_hsd(),
        "anova_2023": model_2023.anova(type=1),
        "tukey_2023": model_2023.tukey_hsd(["BurnTreat"]),
        "summary": arrange(
            summary.withColumn("Bar", interaction_key("BurnTreat", "Exclosure", "Year")),
            "Year", "BurnTreat", "Exclosure"),
        "mixed_variances": three_way.variances(),
        "mixed_coefficients": four_way.coefficients(),
        "mixed_anova": four_way.anova(type=3),
        "mixed_contrasts": four_way.pairwise(["BurnTreat", "Exclosure", "Year", "Drought"]),
        "three_way": three_way,
        "four_way": four_way,
    }
