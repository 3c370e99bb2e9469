"""Quasi-Poisson regression with log link.

Rows sharing all predictor values form one cell with its count and response sums; every
reweighting step works on cells only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plotfield.models import posthoc
from plotfield.models._tables import table
from plotfield.models._tails import chi2_upper, t_two_sided
from plotfield.models.design import Design, Term, find_levels, model_rows, reduce_triangles
from plotfield.models.linear import independent_columns

MAX_STEPS = 50
#: Predictors beyond this have no finite mean; the fit then fails.
LARGEST_ETA = 700.0


class PoissonFit:
    def __init__(self, spark, design: Design, cells: DataFrame) -> None:
        self.spark, self.design, self._cells = spark, design, cells
        every = np.arange(len(design.labels))
        self.beta, self.unscaled, self.deviance, pearson, self.n, self.at = self._fit([every])[0]
        self.rank = int(np.isfinite(self.beta).sum())
        self.df_resid = self.n - self.rank
        self.dispersion = pearson / self.df_resid if self.df_resid > 0 else math.nan

    @property
    def cov(self) -> np.ndarray:
        return self.dispersion * self.unscaled

    def _step(self, models: dict[int, tuple[np.ndarray, np.ndarray | None]]):
        """One weighted pass for all models (columns, beta): each one's working triangle at ``beta`` plus its deviance and Pearson sum."""
        design, covariates = self.design, self.design.covariates

        def rows_of(part: pd.DataFrame):
            every = design.rows(part)
            n, sy = part["__n"].to_numpy(float), part["__sy"].to_numpy(float)
            mean = sy / n
            sums = [n @ part[c].to_numpy(float) for c in covariates]
            out = {}
            for model, (columns, beta) in models.items():
                x = every[:, columns]
                eta = np.log(mean + 0.1) if beta is None else x @ beta
                if np.abs(eta).max() > LARGEST_ETA:
                    raise RuntimeError("the linear predictor has left the range of doubles: the fit diverges")
                mu = np.exp(eta)
                root = np.sqrt(n * mu)
                rows = np.column_stack([x, eta + (mean - mu) / mu]) * root[:, None]
                deviance = 2.0 * (part["__ylogy"].to_numpy(float) - sy * eta - sy + n * mu).sum()
                spread = (part["__css"].to_numpy(float) + n * (mean - mu) ** 2) / mu
                out[model] = rows, np.array([deviance, spread.sum(), n.sum(), *sums])
            return out

        return reduce_triangles(self._cells, rows_of)

    def _fit(self, models: list[np.ndarray]) -> list[tuple]:
        """Fits of the design's columns that each model lists, all in the same passes."""
        going: dict[int, tuple[np.ndarray, np.ndarray | None]] = {m: (columns, None) for m, columns in enumerate(models)}
        state: dict[int, tuple] = {}
        done: dict[int, tuple] = {}
        for _ in range(MAX_STEPS):
            for m, (r, totals) in self._step(going).items():
                columns, beta = going[m]
                if beta is not None:
                    kept, inverse, previous = state[m]
                    if abs(totals[0] - previous) < 1e-10 * (abs(totals[0]) + 0.1):
                        done[m] = self._finished(columns[kept], beta[kept], inverse, totals)
                        del going[m]
                        continue
                kept, basis = independent_columns(r, len(columns))
                inverse = np.linalg.inv(basis @ r[:, kept])
                beta = np.zeros(len(columns))
                beta[kept] = inverse @ (basis @ r[:, len(columns)])
                state[m] = kept, inverse, totals[0] if going[m][1] is not None else math.inf
                going[m] = columns, beta
            if not going:
                return [done[m] for m in range(len(models))]
        raise RuntimeError(f"the fit has not converged after {MAX_STEPS} steps")

    def _finished(self, places: np.ndarray, beta: np.ndarray, inverse: np.ndarray, totals: np.ndarray) -> tuple:
        full = np.full(len(self.design.labels), np.nan)
        full[places] = beta
        unscaled = np.full((len(full), len(full)), np.nan)
        unscaled[np.ix_(places, places)] = inverse @ inverse.T
        at = {c: totals[3 + i] / totals[2] for i, c in enumerate(self.design.covariates)}
        return full, unscaled, totals[0], totals[1], int(round(totals[2])), at

    def coefficients(self) -> DataFrame:
        rows = []
        for j, label in enumerate(self.design.labels):
            se = math.sqrt(self.cov[j, j])
            t = self.beta[j] / se if se > 0 else math.nan
            rows.append((label, self.beta[j], se, t, t_two_sided(t, self.df_resid)))
        return table(self.spark, rows, "term string, estimate double, std_error double, "
                                       "t_value double, p_value double")

    def fit_stats(self) -> DataFrame:
        return table(self.spark, [(self.n, self.df_resid, self.deviance, self.dispersion)],
                     "n long, df_resid long, deviance double, dispersion double")

    def anova(self, type: int = 3) -> DataFrame:
        """Likelihood-ratio test of each term: deviance gained by refitting without its
        columns, over the dispersion of the full model. All refits share their passes."""
        if type != 3:
            raise ValueError("only type 3 is offered")
        owner, names = self.design.owner, self.design.term_names[1:]
        rows = []
        for name, reduced in zip(names, self._fit([np.flatnonzero(owner != i) for i in range(1, len(names) + 1)])):
            df = self.rank - int(np.isfinite(reduced[0]).sum())
            chisq = max(reduced[2] - self.deviance, 0.0) / self.dispersion
            rows.append((name, chisq, df, chi2_upper(chisq, df)))
        return table(self.spark, rows, "term string, lr_chisq double, df long, p_value double")

    def emmeans(self, over: Sequence[str], level: float = 0.95) -> DataFrame:
        """Marginal means on the log scale, with normal limits."""
        return posthoc.emmeans_table(self.spark, self.design, over, self.at, self.beta, self.cov,
                                     lambda row: math.inf, level)

    def pairwise(self, over: Sequence[str], adjust: str = "tukey") -> DataFrame:
        """Log-scale differences of marginal means."""
        return posthoc.pairwise_table(self.spark, self.design, over, self.at, self.beta, self.cov,
                                      lambda row: math.inf, adjust)


def glm_quasipoisson(
    df: DataFrame, y: str, terms: Sequence[Term], covariates: Sequence[str] = (),
    contrasts: str = "treatment", levels: Mapping[str, Sequence[Any]] | None = None,
) -> PoissonFit:
    source = model_rows(df, y, terms, covariates)
    y_col = F.col("__y")
    cells = source.df.groupBy(*source.factors, *source.covariates).agg(
        F.count(F.lit(1)).cast("double").alias("__n"),
        F.sum(y_col).alias("__sy"),
        (F.var_pop(y_col) * F.count(F.lit(1))).alias("__css"),
        F.sum(F.when(y_col > 0, y_col * F.log(y_col)).otherwise(0.0)).alias("__ylogy"),
    )
    cells = cells.persist()
    design = Design(list(terms), find_levels(source, cells, levels or {}), source.covariates,
                    contrasts)
    return PoissonFit(df.sparkSession, design, cells)
