from plotfield.plans.biomass import biomass_study
from plotfield.plans.burn import burn_intensity, diameter_against
from plotfield.plans.cover import cover_study
from plotfield.plans.life_history import (
    cohort_study, establishment_study, reconstruct, subplot_survival_study, survival_study,
)
from plotfield.plans.moisture import moisture_long, moisture_study
from plotfield.plans.severity_paths import severity_study

__all__ = [
    "biomass_study", "burn_intensity", "cohort_study", "cover_study", "diameter_against",
    "establishment_study", "moisture_long", "moisture_study", "reconstruct", "severity_study",
    "subplot_survival_study", "survival_study",
]
