"""Multi-factor linear models with interactions, Type I/II/III tables and post-hoc tests."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plotfield.models import posthoc
from plotfield.models._tables import table
from plotfield.models._tails import f_upper, studentised_range_upper, t_two_sided
from plotfield.models.design import Frame, Term, model_frame

TOLERANCE = 1e-9


def independent_columns(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns kept left to right, skipping those that depend on earlier ones, and their basis."""
    kept, basis = [], []
    for j in range(k):
        v = r[:, j].copy()
        size = np.linalg.norm(v)
        for _ in range(2):
            for q in basis:
                v -= (q @ v) * q
        if size > 0 and np.linalg.norm(v) > TOLERANCE * size:
            kept.append(j)
            basis.append(v / np.linalg.norm(v))
    return np.array(kept), np.array(basis)


class LinearFit:
    def __init__(self, frame: Frame) -> None:
        self.frame, self.design, self.spark = frame, frame.design, frame.spark
        r, k = frame.triangle, len(frame.design.labels)
        self._r, self._y = r, r[:, k]
        self.kept, self._basis = independent_columns(r, k)
        x = r[:, self.kept]
        self._effects = self._basis @ self._y
        self.rss = float(np.sum((self._y - self._basis.T @ self._effects) ** 2))
        upper = self._basis @ x
        self.df_resid = frame.n - len(self.kept)
        self.sigma2 = self.rss / self.df_resid if self.df_resid > 0 else math.nan
        inverse = np.linalg.inv(upper)
        self.beta = np.full(k, np.nan)
        self.beta[self.kept] = inverse @ self._effects
        self.unscaled = np.full((k, k), np.nan)
        self.unscaled[np.ix_(self.kept, self.kept)] = inverse @ inverse.T

    @property
    def cov(self) -> np.ndarray:
        return self.sigma2 * self.unscaled

    def coefficients(self) -> DataFrame:
        rows = []
        for j, label in enumerate(self.design.labels):
            se = math.sqrt(self.cov[j, j]) if j in self.kept else math.nan
            t = self.beta[j] / se if se > 0 else math.nan
            rows.append((label, self.beta[j], se, t, t_two_sided(t, self.df_resid)))
        return table(self.spark, rows, "term string, estimate double, std_error double, "
                                       "t_value double, p_value double")

    def fit_stats(self) -> DataFrame:
        total = float(np.sum(self._y**2) - self._effects[0] ** 2)
        p = len(self.kept) - 1
        r2 = 1.0 - self.rss / total if total > 0 else math.nan
        f = ((total - self.rss) / p) / self.sigma2 if p and self.sigma2 > 0 else math.nan
        adjusted = 1.0 - (1.0 - r2) * (self.frame.n - 1) / self.df_resid if self.df_resid else r2
        return table(
            self.spark,
            [(self.frame.n, self.df_resid, math.sqrt(self.sigma2), r2, adjusted, f,
              f_upper(f, p, self.df_resid) if p else math.nan)],
            "n long, df_resid long, sigma double, r_squared double, adj_r_squared double, "
            "f_value double, p_value double")

    def _rss(self, columns: np.ndarray) -> float:
        if not len(columns):
            return float(np.sum(self._y**2))
        x = self._r[:, columns]
        solution = np.linalg.lstsq(x, self._y, rcond=None)[0]
        return float(np.sum((self._y - x @ solution) ** 2))

    def _sums_of_squares(self, kind: int) -> list[tuple[str, float, int]]:
        design, names = self.design, self.design.term_names
        out = []
        for i in range(0 if kind == 3 else 1, len(names)):
            inside = np.isin(self.kept, design.columns_of(i))
            df = int(inside.sum())
            if df == 0:
                continue
            if kind == 1:
                ss = float(np.sum(self._effects[inside] ** 2))
            elif kind == 2:
                this = set(design.terms[i - 1])
                others = [0] + [m for m, t in enumerate(design.terms, start=1)
                                if m != i and not this < set(t)]
                base = self.kept[np.isin(design.owner[self.kept], others)]
                ss = self._rss(base) - self._rss(np.sort(np.append(base, self.kept[inside])))
            elif kind == 3:
                c = self.kept[inside]
                ss = float(self.beta[c] @ np.linalg.solve(self.unscaled[np.ix_(c, c)],
                                                          self.beta[c]))
            else:
                raise ValueError("type is 1, 2 or 3")
            out.append((names[i], ss, df))
        return out

    def anova(self, type: int = 1) -> DataFrame:
        """Sequential (1), marginality-respecting (2) or coefficient-block (3) tests.

        Type 3 depends on the contrast coding: with treatment coding it tests simple effects
        at the baseline levels.
        """
        rows = []
        for name, ss, df in self._sums_of_squares(type):
            f = ss / df / self.sigma2
            rows.append((name, ss, df, f, f_upper(f, df, self.df_resid)))
        rows.append(("Residuals", self.rss, self.df_resid, math.nan, math.nan))
        return table(self.spark, rows, "term string, sum_sq double, df long, f_value double, "
                                       "p_value double")

    def _estimable(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.kept) < len(self.beta):
            raise ValueError("marginal means need a design without empty cells")
        return self.beta, self.cov

    def emmeans(self, over: Sequence[str], level: float = 0.95) -> DataFrame:
        beta, cov = self._estimable()
        return posthoc.emmeans_table(self.spark, self.design, over, self.frame.at, beta, cov,
                                     lambda row: float(self.df_resid), level)

    def pairwise(self, over: Sequence[str], adjust: str = "tukey") -> DataFrame:
        beta, cov = self._estimable()
        return posthoc.pairwise_table(self.spark, self.design, over, self.frame.at, beta, cov,
                                      lambda row: float(self.df_resid), adjust)

    def _term_means(self, term: Term) -> DataFrame:
        """(i, label, n, mean) of the cell means of a factor term, ``i`` their place in the order of the levels, first factor fastest."""
        total = f"__m{len(self.design.monomials)}"
        place, stride = F.lit(0).cast("long"), 1
        for f in term:
            levels = self.design.levels[f]
            codes = F.create_map(*[F.lit(x) for j, level in enumerate(levels) for x in (level, j)])
            place, stride = place + F.element_at(codes, F.col(f)) * stride, stride * len(levels)
        return self.frame.cells.groupBy(*term).agg(
            F.sum("__n").alias("n"), (F.sum(F.col("__n") * F.col(total)) / F.sum("__n")).alias("mean")).select(
            place.alias("i"), F.concat_ws(":", *term).alias("label"), "n", "mean")

    def _term_pairs(self, term: Term) -> DataFrame:
        """Differences of all pairs of a term's means: each mean lists the later places, and these meet their means by an equality."""
        means = self._term_means(term)
        k, df, half = means.count(), float(self.df_resid), self.sigma2 / 2.0
        later = means.select(F.col("i").alias("j"), F.col("label").alias("other"), F.col("n").alias("m"), F.col("mean").alias("upper"))
        places = math.prod(len(self.design.levels[f]) for f in term)
        pairs = means.where(F.col("i") < places - 1).withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.lit(places - 1).cast("long")))).join(later, "j")

        @F.pandas_udf("double")
        def tail(q: pd.Series) -> pd.Series:
            return pd.Series([studentised_range_upper(x, k, df) for x in q], dtype="float64")

        return pairs.withColumns({
            "diff": F.col("upper") - F.col("mean"), "se": F.sqrt(F.lit(half) * (1 / F.col("n") + 1 / F.col("m"))),
        }).select(F.lit(":".join(term)).alias("term"), F.concat("other", F.lit("-"), "label").alias("comparison"), "diff", "se",
                  tail(F.abs("diff") / F.col("se")).alias("p_adj"))

    def tukey_hsd(self, terms: Sequence[Term | str] | None = None) -> DataFrame:
        """All pairwise differences of the cell means of each factor term."""
        wanted = [(t,) if isinstance(t, str) else tuple(t) for t in terms] if terms else [
            t for t in self.design.terms if all(v in self.design.levels for v in t)]
        return reduce(DataFrame.unionByName, [self._term_pairs(t) for t in wanted])


def linear_model(
    df: DataFrame, y: str, terms: Sequence[Term], covariates: Sequence[str] = (),
    contrasts: str = "treatment", levels: Mapping[str, Sequence[Any]] | None = None,
) -> LinearFit:
    """Least-squares fit. Variables are factors unless named in ``covariates``."""
    return LinearFit(model_frame(df, y, terms, covariates, contrasts, levels))
