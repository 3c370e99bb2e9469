"""Recursive path models among observed variables, by maximum likelihood.

One aggregation gives the covariance matrix; the rest is algebra on it. With no feedback
and uncorrelated residuals (or correlated ones among final outcomes with the same
predictors) maximum likelihood equals equation-wise least squares.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plotfield.models._tables import table
from plotfield.models._tails import chi2_upper, normal_two_sided

Path = tuple[str, str]
Effect = Sequence[Sequence[Path]]


def moments(df: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Complete-case count, means and population covariance matrix, in one pass."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    if not found["n"]:
        raise ValueError("no complete rows to fit")
    cov = np.empty((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = found[f"c{i}_{j}"]
    return found["n"], np.array([found[f"m{i}"] for i in range(len(names))]), cov


class PathFit:
    def __init__(self, spark, n, names, means, cov, equations, fixed, residual_pairs) -> None:
        self.spark, self.n, self.names = spark, n, list(names)
        self.means, self.sample, self.equations = means, cov, equations
        self.fixed, self._residual_pairs = fixed, residual_pairs
        self._index = {v: i for i, v in enumerate(names)}
        size = len(names)
        self.exogenous = [v for v in names if v not in equations]
        self.paths = [(y, x) for y, xs in equations.items() for x in xs]
        self.b, self.intercepts = np.zeros((size, size)), means.copy()
        for y, xs in equations.items():
            i, p = self._index[y], [self._index[x] for x in xs]
            self.b[i, p] = np.linalg.solve(cov[np.ix_(p, p)], cov[p, i])
            self.intercepts[i] = means[i] - self.b[i, p] @ means[p]
        step = np.eye(size) - self.b
        self.psi = np.zeros((size, size))
        residual = step @ cov @ step.T
        for v in names:
            i = self._index[v]
            self.psi[i, i] = fixed.get(v, residual[i, i])
        free = residual_pairs + list(combinations(self.exogenous, 2))
        for a, c in free:
            i, j = self._index[a], self._index[c]
            self.psi[i, j] = self.psi[j, i] = residual[i, j]
        inverse = np.linalg.inv(step)
        self.implied = inverse @ self.psi @ inverse.T
        # Expected information: each equation's block uses the model-implied moments.
        self.path_cov = np.zeros((len(self.paths), len(self.paths)))
        for y, xs in equations.items():
            i, p = self._index[y], [self._index[x] for x in xs]
            at = [self.paths.index((y, x)) for x in xs]
            self.path_cov[np.ix_(at, at)] = (
                self.psi[i, i] / n * np.linalg.inv(self.implied[np.ix_(p, p)]))

    def _value(self, path: Path) -> float:
        if path not in self.paths:
            raise ValueError(f"no path {path}")
        return float(self.b[self._index[path[0]], self._index[path[1]]])

    def _standard(self, path: Path) -> float:
        y, x = self._index[path[0]], self._index[path[1]]
        return float(self.b[y, x] * math.sqrt(self.implied[x, x] / self.implied[y, y]))

    def coefficients(self) -> DataFrame:
        """Paths, residual variances and intercepts, with z tests and standardised values."""
        rows = []
        for k, (y, x) in enumerate(self.paths):
            value, se = self._value((y, x)), math.sqrt(self.path_cov[k, k])
            rows.append((y, "~", x, value, se, value / se, normal_two_sided(value / se),
                         self._standard((y, x))))
        for v in self.names:
            i = self._index[v]
            value = self.psi[i, i]
            se = 0.0 if v in self.fixed else value * math.sqrt(2.0 / self.n)
            z = value / se if se > 0 else math.nan
            rows.append((v, "~~", v, value, se, z, normal_two_sided(z) if se > 0 else math.nan,
                         value / self.implied[i, i]))
        for a, c in self._residual_pairs:
            i, j = self._index[a], self._index[c]
            value = self.psi[i, j]
            se = math.sqrt((self.psi[i, i] * self.psi[j, j] + value**2) / self.n)
            rows.append((a, "~~", c, value, se, value / se, normal_two_sided(value / se),
                         value / math.sqrt(self.psi[i, i] * self.psi[j, j])))
        for v in self.names:
            i = self._index[v]
            value = self.intercepts[i]
            if v in self.equations:
                p = [self._index[x] for x in self.equations[v]]
                around = self.means[p] @ np.linalg.inv(self.implied[np.ix_(p, p)]) @ self.means[p]
                se = math.sqrt(self.psi[i, i] / self.n * (1.0 + around))
            else:
                se = math.sqrt(self.psi[i, i] / self.n)
            z = value / se if se > 0 else math.nan
            rows.append((v, "~1", "", value, se, z, normal_two_sided(z),
                         value / math.sqrt(self.implied[i, i])))
        return table(self.spark, rows, "lhs string, op string, rhs string, estimate double, "
                                       "se double, z double, p_value double, standardised double")

    def effects(self, definitions: Mapping[str, Effect]) -> DataFrame:
        """Sums of products of paths, with delta-method standard errors.

        An effect is a list of routes; a route is a list of ``(outcome, predictor)`` paths.
        """
        rows = []
        for name, routes in definitions.items():
            value, standard, gradient = 0.0, 0.0, np.zeros(len(self.paths))
            for route in routes:
                values = [self._value(p) for p in route]
                value += math.prod(values)
                standard += math.prod(self._standard(p) for p in route)
                for k, p in enumerate(route):
                    gradient[self.paths.index(p)] += math.prod(values[:k] + values[k + 1:])
            se = math.sqrt(gradient @ self.path_cov @ gradient)
            z = value / se if se > 0 else math.nan
            rows.append((name, value, se, z, normal_two_sided(z), standard))
        return table(self.spark, rows, "effect string, estimate double, se double, z double, "
                                       "p_value double, standardised double")

    def fit(self, random_exogenous: bool | None = None) -> DataFrame:
        """Chi-square, CFI, TLI, RMSEA, SRMR, log-likelihood, AIC and BIC.

        ``random_exogenous`` says whether exogenous moments count as estimated; by default
        they do only if one of their variances is fixed by the user.
        """
        random = bool(self.fixed) if random_exogenous is None else random_exogenous
        n, p, s, implied = self.n, len(self.names), self.sample, self.implied
        q = len(self.exogenous)

        def discrepancy(sigma: np.ndarray) -> float:
            ratio = np.linalg.solve(sigma, s)
            return float(np.trace(ratio) - np.linalg.slogdet(ratio)[1] - p)

        x_moments = q * (q + 1) // 2
        free = len(self.paths) + len(self.equations) + len(self._residual_pairs)
        free += x_moments - len([v for v in self.fixed if v in self.exogenous])
        free -= len([v for v in self.fixed if v in self.equations])
        df = p * (p + 1) // 2 - free
        chisq = max(n * discrepancy(implied), 0.0)
        baseline = np.diag(np.diag(s))
        if not random:
            x = [self._index[v] for v in self.exogenous]
            baseline[np.ix_(x, x)] = s[np.ix_(x, x)]
        base_chisq = n * discrepancy(baseline)
        base_df = p * (p - 1) // 2 - (0 if random else q * (q - 1) // 2)
        excess, base_excess = max(chisq - df, 0.0), max(base_chisq - base_df, chisq - df, 0.0)
        cfi = 1.0 - excess / base_excess if base_excess > 0 else 1.0
        tli = (((base_chisq / base_df - chisq / df) / (base_chisq / base_df - 1.0))
               if df > 0 and base_chisq != base_df else 1.0)
        rmsea = math.sqrt(excess / (n * df)) if df > 0 else 0.0
        root = np.sqrt(np.diag(s))
        gap = (s - implied) / np.outer(root, root)
        # Mean residuals are zero; they still count as fitted moments.
        srmr = math.sqrt(float(np.sum(np.tril(gap) ** 2)) / (p * (p + 1) / 2 + p))
        logl = -0.5 * n * (p * math.log(2.0 * math.pi) + np.linalg.slogdet(implied)[1]
                           + np.trace(np.linalg.solve(implied, s)))
        parameters = free + p
        if not random:
            x = [self._index[v] for v in self.exogenous]
            block = implied[np.ix_(x, x)]
            logl += 0.5 * n * (q * math.log(2.0 * math.pi) + np.linalg.slogdet(block)[1]
                               + np.trace(np.linalg.solve(block, s[np.ix_(x, x)])))
            parameters -= x_moments + q
        return table(
            self.spark,
            [(n, parameters, chisq, df, chi2_upper(chisq, df) if df > 0 else math.nan, cfi, tli,
              rmsea, srmr, logl, 2 * parameters - 2 * logl, parameters * math.log(n) - 2 * logl)],
            "n long, n_parameters long, chisq double, df long, p_value double, cfi double, "
            "tli double, rmsea double, srmr double, loglik double, aic double, bic double")


def path_model(
    df: DataFrame, equations: Mapping[str, Sequence[str]],
    fixed_var: Mapping[str, float] | None = None, residual_cov: str = "outcomes",
) -> PathFit:
    """Fit ``{outcome: predictors}``, given so that each predictor's own equation comes first.

    ``residual_cov='outcomes'`` frees the residual covariance of outcomes that predict
    nothing; ``'none'`` keeps all residuals uncorrelated.
    """
    if residual_cov not in ("outcomes", "none"):
        raise ValueError("residual_cov is 'outcomes' or 'none'")
    done: set[str] = set()
    later = set(equations)
    for y, xs in equations.items():
        later.discard(y)
        bad = [x for x in xs if x == y or x in later]
        if bad:
            raise ValueError(f"{y} depends on {bad}, which comes later: not recursive")
        done.add(y)
    predictors = {x for xs in equations.values() for x in xs}
    exogenous = [x for x in dict.fromkeys(x for xs in equations.values() for x in xs)
                 if x not in equations]
    names = [*equations, *exogenous]
    pairs: list[Path] = []
    if residual_cov == "outcomes":
        final = [y for y in equations if y not in predictors]
        pairs = list(combinations(final, 2))
        for a, c in pairs:
            if set(equations[a]) != set(equations[c]):
                raise ValueError(
                    f"{a} and {c} have correlated residuals but different predictors; "
                    "use residual_cov='none'")
    n, means, cov = moments(df, names)
    return PathFit(df.sparkSession, n, names, means, cov,
                   {y: list(xs) for y, xs in equations.items()}, dict(fixed_var or {}), pairs)
