"""Binomial mixed model (logit link, one random intercept) by the Laplace approximation.

Rows sharing group and predictor values collapse to trials and successes before they meet, so a
group of any size is one row of as many cells as it has different predictor values. Tasks find
the modes of their own groups and add up their part of the objective; one pass over the groups
serves several points of the search, and nothing but sums reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotfield.models import posthoc
from plotfield.models._tables import table
from plotfield.models._tails import normal_two_sided
from plotfield.models.design import Design, Term, find_levels, model_rows
from plotfield.models.mixed import wald_table

MODE_STEPS = 60
MODE_TOLERANCE = 1e-10


class _Cells:
    """Deviance, gradient, score and information of the groups of one task."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.n, self.s, self.x = values[:, 0], values[:, 1], values[:, 2:]
        self.g, self.groups = np.repeat(np.arange(len(sizes)), sizes), len(sizes)

    def _sum(self, values: np.ndarray) -> np.ndarray:
        if values.ndim == 1:
            return np.bincount(self.g, values, self.groups)
        return np.column_stack([self._sum(values[:, j]) for j in range(values.shape[1])])

    @staticmethod
    def _logistic(eta: np.ndarray) -> np.ndarray:
        small = np.exp(-np.abs(eta))
        return np.where(eta >= 0.0, 1.0, small) / (1.0 + small)

    def information(self, beta: np.ndarray) -> np.ndarray:
        """Score and information of the model without random effects, in one array."""
        p = self._logistic(self.x @ beta)
        return np.concatenate([self.x.T @ (self.s - self.n * p),
                               ((self.x * (self.n * p * (1.0 - p))[:, None]).T @ self.x).ravel()])

    def evaluate(self, theta: float, beta: np.ndarray) -> np.ndarray:
        """Deviance, slope in theta and slopes in beta."""
        fixed, u = self.x @ beta, np.zeros(self.groups)
        for _ in range(MODE_STEPS):
            p = self._logistic(fixed + theta * u[self.g])
            pull = theta * self._sum(self.s - self.n * p) - u
            # Steps are shortened; the loop goes on until there are none to make.
            move = np.clip(
                pull / (1.0 + theta**2 * self._sum(self.n * p * (1.0 - p))), -3.0, 3.0)
            u = u + move
            if np.abs(move).max() < MODE_TOLERANCE:
                break
        else:
            raise RuntimeError(f"a group's mode has not converged after {MODE_STEPS} steps")
        eta = fixed + theta * u[self.g]
        p = self._logistic(eta)
        r, w = self.s - self.n * p, self.n * p * (1.0 - p)
        v = w * (1.0 - 2.0 * p)
        sr, sw, sv = self._sum(r), self._sum(w), self._sum(v)
        h = 1.0 + theta**2 * sw
        loglik = (self.s * eta - self.n * np.logaddexp(0.0, eta)).sum()
        deviance = -2.0 * loglik + (u**2).sum() + np.log(h).sum()
        swx, svx = self._sum(w[:, None] * self.x), self._sum(v[:, None] * self.x)
        du_beta = -theta * swx / h[:, None]
        du_theta = (sr - theta * u * sw) / h
        grad_beta = -2.0 * (r @ self.x) + (
            theta**2 * (svx + theta * sv[:, None] * du_beta) / h[:, None]).sum(axis=0)
        grad_theta = -2.0 * (sr @ u) + (
            (2.0 * theta * sw + theta**2 * sv * (u + theta * du_theta)) / h).sum()
        return np.concatenate([[deviance, grad_theta], grad_beta])


class _Objective:
    """Sums of :class:`_Cells` over all groups; one job for any number of points."""

    def __init__(self, cells: DataFrame, design: Design) -> None:
        self.k = len(design.labels)
        row = F.array("__n", "__s", *[c.cast("double") for c in design.expressions()])
        self.rows = (cells.select("__g", row.alias("row")).groupBy("__g")
                     .agg(F.flatten(F.collect_list("row")).alias("cells")).select("cells").persist())
        self.groups = self.rows.count()

    def _total(self, points: list, evaluate: Callable[[_Cells, Any], np.ndarray]) -> np.ndarray:
        width = self.k + 2

        def per_partition(batches):
            total = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch.column(0)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False) // width
                part = _Cells(lists.flatten().to_numpy().reshape(-1, width), sizes)
                found = np.array([evaluate(part, point) for point in points])
                total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([total.ravel()], pa.list_(pa.float64()))})

        found = self.rows.mapInArrow(per_partition, "sums array<double>").collect()
        return np.sum([np.array(r.sums) for r in found], axis=0).reshape(len(points), -1)

    def information(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self._total([beta], lambda part, b: part.information(b))[0]
        return found[:self.k], found[self.k:].reshape(self.k, self.k)

    def evaluate(self, *points: tuple[float, np.ndarray]) -> list[tuple[float, np.ndarray]]:
        found = self._total(list(points), lambda part, point: part.evaluate(*point))
        return [(float(row[0]), row[1:]) for row in found]


def _minimise(evaluate: Callable, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Quasi-Newton descent with backtracking, on well-scaled coordinates."""
    x, inverse = start.copy(), np.eye(len(start))
    value, gradient = evaluate(x)
    for _ in range(300):
        if np.abs(gradient).max() < 1e-7 * (1.0 + abs(value)):
            break
        direction = -inverse @ gradient
        slope = gradient @ direction
        if slope >= 0.0:
            inverse, direction = np.eye(len(x)), -gradient
            slope = gradient @ direction
        length = min(1.0, 4.0 / max(np.abs(direction).max(), 1e-12))
        while True:
            trial, trial_gradient = evaluate(x + length * direction)
            if trial <= value + 1e-4 * length * slope or length < 1e-12:
                break
            length *= 0.5
        moved, change = length * direction, trial_gradient - gradient
        stalled = value - trial < 1e-13 * (1.0 + abs(value))
        x, value, gradient = x + moved, trial, trial_gradient
        if stalled:
            break  # no descent is left in the arithmetic
        curvature = moved @ change
        if curvature > 1e-12:
            mixed = np.eye(len(x)) - np.outer(moved, change) / curvature
            inverse = mixed @ inverse @ mixed.T + np.outer(moved, moved) / curvature
    else:
        raise RuntimeError("the fit has not converged after 300 steps")
    return value, x, gradient


class BinomialMixedFit:
    def __init__(self, spark, design: Design, objective: _Objective, n: int,
                 at: dict[str, float]) -> None:
        self.spark, self.design, self.objective, self.n, self.at = spark, design, objective, n, at
        k = len(design.labels)
        beta = np.zeros(k)
        for _ in range(25):
            score, info = objective.information(beta)
            move = np.linalg.lstsq(info, score, rcond=1e-10)[0]
            beta = beta + move
            if np.abs(move).max() < 1e-6:
                break
        else:
            raise RuntimeError("the fit without random effects has not converged after 25 steps")
        _, info = objective.information(beta)
        if np.linalg.matrix_rank(info) < k:
            raise ValueError("the design has empty cells or dependent columns")
        scale = np.linalg.inv(np.linalg.cholesky(info)).T

        def scaled_all(*points: np.ndarray) -> list[tuple[float, np.ndarray]]:
            found = objective.evaluate(*[(float(z[0]), beta + scale @ z[1:]) for z in points])
            return [(value, np.append(g[0], scale.T @ g[1:])) for value, g in found]

        def scaled(z: np.ndarray) -> tuple[float, np.ndarray]:
            return scaled_all(z)[0]

        start = np.zeros(k + 1)
        start[0] = 1.0
        value, z, gradient = _minimise(scaled, start)
        # Differences of the exact gradient give the curvature; one Newton step polishes.
        for _ in range(2):
            step = 1e-4
            around = scaled_all(*[z + sign * step * e for e in np.eye(k + 1) for sign in (1, -1)])
            hessian = np.array([(around[2 * i][1] - around[2 * i + 1][1]) / (2 * step) for i in range(k + 1)])
            hessian = 0.5 * (hessian + hessian.T)
            polished = z - np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            better, better_gradient = scaled(polished)
            if not better < value - 1e-9:
                break
            value, z, gradient = better, polished, better_gradient
        self.deviance = value
        self.group_sd = abs(float(z[0]))
        back = design.centring(at)
        self.beta = back @ (beta + scale @ z[1:])
        self.cov = back @ scale @ (2.0 * np.linalg.inv(hessian)[1:, 1:]) @ scale.T @ back.T

    def coefficients(self) -> DataFrame:
        rows = []
        for j, label in enumerate(self.design.labels):
            se = math.sqrt(self.cov[j, j])
            z = self.beta[j] / se
            rows.append((label, self.beta[j], se, z, normal_two_sided(z)))
        return table(self.spark, rows, "term string, estimate double, std_error double, "
                                       "z_value double, p_value double")

    def fit_stats(self) -> DataFrame:
        parameters = len(self.beta) + 1
        return table(
            self.spark,
            [(self.n, self.objective.groups, self.group_sd**2, self.deviance,
              self.deviance + 2 * parameters, self.deviance + parameters * math.log(self.n))],
            "n long, n_groups long, group_variance double, deviance double, aic double, "
            "bic double")

    def anova(self, type: int = 3) -> DataFrame:
        """Wald chi-square of each term's coefficient block."""
        if type != 3:
            raise ValueError("only type 3 is offered")
        return wald_table(self.spark, self.design, np.arange(len(self.beta)), self.beta, self.cov)

    def emmeans(self, over: Sequence[str], level: float = 0.95) -> DataFrame:
        """Marginal means on the logit scale."""
        return posthoc.emmeans_table(self.spark, self.design, over, self.at, self.beta, self.cov,
                                     lambda row: math.inf, level)

    def pairwise(self, over: Sequence[str], adjust: str = "tukey") -> DataFrame:
        return posthoc.pairwise_table(self.spark, self.design, over, self.at, self.beta, self.cov,
                                      lambda row: math.inf, adjust)


def glmm_binomial(
    df: DataFrame, y: str, fixed: Sequence[Term], group: str, covariates: Sequence[str] = (),
    contrasts: str = "treatment", levels: Mapping[str, Sequence[Any]] | None = None,
) -> BinomialMixedFit:
    """Fit a 0/1 response ``y`` with fixed terms and a random intercept per ``group``.

    The different predictor values of one group must fit a task's memory; rows may be any number.
    """
    source = model_rows(df, y, fixed, covariates, extra=[group])
    keys = [*source.factors, *source.covariates]
    cells = source.df.groupBy(F.col(f"__{group}").alias("__g"), *keys).agg(
        F.count(F.lit(1)).cast("double").alias("__n"), F.sum("__y").cast("double").alias("__s")).persist()
    design = Design(list(fixed), find_levels(source, cells, levels or {}), source.covariates,
                    contrasts)
    # Covariates enter centred; coefficients are carried back to the raw scale.
    totals = cells.agg(F.sum("__n"), *[F.sum(F.col("__n") * F.col(c)) for c in source.covariates]).first()
    if not totals[0]:
        raise ValueError("no complete rows to fit")
    at = {c: totals[1 + i] / totals[0] for i, c in enumerate(source.covariates)}
    centred = cells.withColumns({c: F.col(c) - m for c, m in at.items()}) if at else cells
    return BinomialMixedFit(df.sparkSession, design, _Objective(centred, design), int(round(totals[0])), at)
