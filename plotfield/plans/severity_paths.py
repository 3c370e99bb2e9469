"""Direct and indirect effects of fire severity on seedlings and their survival."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from plotfield.models import path_model
from plotfield.operators import mean_sd_table, summarise_across, var_table, zscore
from plotfield.operators.reshape import longer_values
from plotfield.plans.experiment import BURNED_PLOTS, with_burn

FIRE, COVER, SEEDLINGS, SURVIVAL = (
    "fire_severity", "log_invasive_cover", "n_seedlings_total", "survival2022")
MEASURES = ["twig_dm", "invasive_cover", "total_cover", "relative_invasive", SEEDLINGS]

FULL = {COVER: [FIRE], SEEDLINGS: [FIRE, COVER], SURVIVAL: [FIRE, COVER, SEEDLINGS]}
REDUCED = {COVER: [FIRE], SEEDLINGS: [COVER, FIRE], SURVIVAL: [COVER, FIRE]}

A1, B1, B2 = (COVER, FIRE), (SEEDLINGS, FIRE), (SEEDLINGS, COVER)
C1, C2, C3 = (SURVIVAL, FIRE), (SURVIVAL, COVER), (SURVIVAL, SEEDLINGS)
# Names under which the effects are reported.
FULL_EFFECTS = {
    "indirect_fire_to_seedlings": [[A1, B2]],
    "indirect_fire_to_survival_via_invasive": [[A1, C2]],
    "indirect_fire_to_survival_via_seedlings": [[B1, C3]],
    "indirect_fire_to_survival_via_both": [[A1, B2, C3]],
    "total_fire_to_seedlings": [[B1], [A1, B2]],
    "total_fire_to_survival": [[C1], [A1, C2], [B1, C3], [A1, B2, C3]],
}
REDUCED_EFFECTS = {
    "indirect_seedlings": [[A1, B2]],
    "indirect_survival": [[A1, C2]],
    "total_seedlings": [[B1], [A1, B2]],
    "total_survival": [[C1], [A1, C2]],
}


def severity_study(plots: DataFrame, survival: str = "2022_survival") -> dict[str, Any]:
    """``plots``: one row per plot with the measures and the survival share."""
    all_plots = with_burn(plots.withColumnRenamed(survival, SURVIVAL), "plot")
    burned = all_plots.where(F.col("plot") <= max(BURNED_PLOTS)).withColumn(
        FIRE, F.col("twig_dm").cast("double"))
    burned = zscore(burned, [FIRE]).withColumn(COVER, F.log1p("invasive_cover"))
    scaled = zscore(burned, [FIRE, COVER, SEEDLINGS, SURVIVAL])
    full = path_model(scaled, FULL)
    full_raw = path_model(burned, FULL)
    reduced = path_model(burned, REDUCED, fixed_var={FIRE: 1.0})
    return {
        "summary": longer_values(
            summarise_across(all_plots, ["BurnTreat"], [*MEASURES, SURVIVAL]), ["BurnTreat"]),
        "publication_table": mean_sd_table(burned, ["BurnTreat"], [FIRE, *MEASURES, SURVIVAL]),
        "variables": var_table(scaled, [COVER, SEEDLINGS, SURVIVAL, FIRE]),
        "full": full.coefficients(),
        "full_effects": full.effects(FULL_EFFECTS),
        "full_fit": full.fit(),
        "full_unscaled": full_raw.coefficients(),
        "reduced": reduced.coefficients(),
        "reduced_effects": reduced.effects(REDUCED_EFFECTS),
        "reduced_fit": reduced.fit(),
    }
