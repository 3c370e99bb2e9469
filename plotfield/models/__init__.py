from plotfield.models.glm import glm_quasipoisson
from plotfield.models.glmm import glmm_binomial
from plotfield.models.linear import linear_model
from plotfield.models.mixed import lmm
from plotfield.models.paths import path_model
from plotfield.models.simple import fit_band, ols, welch_t
from plotfield.models.design import crossed, terms

__all__ = [
    "crossed", "fit_band", "glm_quasipoisson", "glmm_binomial", "linear_model", "lmm", "ols",
    "path_model", "terms", "welch_t",
]
