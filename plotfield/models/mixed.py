"""Linear mixed model with one random intercept, fitted by REML.

With variance ratio ``r`` the weighted cross-products are the plain ones minus
``r / (1 + r n)`` times the outer product of each group's column sums. So one pass gives the
plain triangle, another the outer products added up by group size, and the search over
``r`` never touches groups again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotfield.models import posthoc
from plotfield.models._tables import table
from plotfield.models._tails import chi2_upper, t_two_sided
from plotfield.models.design import Frame, Term, cell_sums, frame_of, model_rows
from plotfield.models.linear import independent_columns

# Numbers that a task holds before it hands its partial sums on.
HELD_NUMBERS = 1_000_000


def _group_products(sums: DataFrame, group: str, frame: Frame, shift: float) -> DataFrame:
    """Per group size: number of groups and summed outer products of group column sums.

    Column sums are plain grouped sums, combined on the map side, so a group of any size
    arrives as one row of fixed width.
    """
    design = frame.design
    monomials = design.monomials
    measured = {m: F.col(f"__s{i}") for i, m in enumerate(monomials)}
    y = F.col(f"__s{len(monomials)}") - shift * F.col("__n")
    columns = [design.coded(choice) * (measured[m] if m else F.col("__n"))
               for choice, m in design.parts]
    totals = sums.groupBy(group).agg(
        F.sum("__n").alias("size"),
        *[F.sum(c).alias(f"__z{i}") for i, c in enumerate([*columns, y])]).drop(group)

    def emit(by_size):
        return pa.RecordBatch.from_pydict({
            "size": pa.array(list(by_size), pa.int64()),
            "groups": pa.array([e[0] for e in by_size.values()], pa.int64()),
            "products": pa.array([e[1].ravel() for e in by_size.values()],
                                 pa.list_(pa.float64())),
        })

    def per_partition(batches):
        by_size: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.rint(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            z = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            for size in np.unique(sizes):
                chosen = z[sizes == size]
                entry = by_size.setdefault(int(size), [0, 0.0])
                entry[0] += len(chosen)
                entry[1] = entry[1] + chosen.T @ chosen
                # Partial sums may be handed on at any time, which bounds the task's memory.
                if len(by_size) * z.shape[1] ** 2 > HELD_NUMBERS:
                    yield emit(by_size)
                    by_size = {}
        if by_size:
            yield emit(by_size)

    parts = totals.mapInArrow(per_partition, "size long, groups long, products array<double>")
    # Entry 0 carries the group count, the rest the products.
    entries = parts.select("size", F.posexplode(
        F.concat(F.array(F.col("groups").cast("double")), F.col("products"))))
    return entries.groupBy("size", "pos").agg(F.sum("col").alias("total"))


class _Products:
    """Sums over group sizes, weighted by a variance ratio. Several ratios cost one aggregation."""

    def __init__(self, entries: DataFrame, width: int) -> None:
        self._width, self._entries, self._known = width, entries.persist(), {}
        self.n_groups = int(round(self._entries.where("pos = 0").agg(F.sum("total")).first()[0]))

    def prepare(self, ratios: Sequence[float]) -> None:
        """Evaluate the ratios that are not known yet, all in one pass."""
        new = [r for r in dict.fromkeys(map(float, ratios)) if r not in self._known]
        if not new:
            return
        w, size, first = self._width, F.col("size").cast("double"), F.col("pos") == 0
        sums = []
        for ratio in new:
            grown = 1.0 + size * ratio
            sums += [F.sum(F.col("total") * F.when(first, F.log(grown)).otherwise(ratio / grown)),
                     F.sum(F.col("total") * F.when(first, size / grown).otherwise(1 / (grown * grown)))]
        found = np.array(self._entries.groupBy("pos").agg(*sums).orderBy("pos").collect(), dtype=float)[:, 1:]
        for i, ratio in enumerate(new):
            value, slope = found[:, 2 * i], found[:, 2 * i + 1]
            self._known[ratio] = (float(value[0]), value[1:].reshape(w, w),
                                  float(slope[0]), slope[1:].reshape(w, w))

    def at(self, ratio: float) -> tuple[float, np.ndarray, float, np.ndarray]:
        """Sum of log(1 + r n) and the correction matrix over all groups, and their slopes."""
        self.prepare([ratio])
        return self._known[float(ratio)]


class MixedFit:
    def __init__(self, frame: Frame, products: _Products, n_groups: int, shift: float) -> None:
        self.frame, self.design, self.spark = frame, frame.design, frame.spark
        self.n_groups = n_groups
        k = len(frame.design.labels)
        r = frame.triangle.copy()
        r[:, k] -= shift * r[:, 0]
        # Covariates are centred for the cross-products, which square the conditioning.
        self._centring = np.eye(k + 1)
        self._centring[:k, :k] = frame.design.centring(frame.at)
        r = r @ self._centring
        self.kept, _ = independent_columns(r, k)
        chosen = np.append(self.kept, k)
        self._plain = (r.T @ r)[np.ix_(chosen, chosen)]
        self._chosen, self._products, self._shift = chosen, products, shift
        self._df = frame.n - len(self.kept)
        self.ratio = self._search()
        self.deviance, self.sigma2, beta, inverse = self._profile(self.ratio)
        self.group_variance = self.ratio * self.sigma2
        self._back = self._centring[np.ix_(self.kept, self.kept)]
        beta = self._back @ beta
        beta[0] += shift
        self.beta = np.full(k, np.nan)
        self.beta[self.kept] = beta
        self.cov = np.full((k, k), np.nan)
        self.cov[np.ix_(self.kept, self.kept)] = self.sigma2 * self._back @ inverse @ self._back.T
        self._variation = None

    def _solve(self, ratio: float):
        log_v, correction, _, _ = self._products.at(ratio)
        correction = self._centring.T @ correction @ self._centring
        a = self._plain - correction[np.ix_(self._chosen, self._chosen)]
        x, xy, yy = a[:-1, :-1], a[:-1, -1], a[-1, -1]
        beta = np.linalg.solve(x, xy)
        rss = max(yy - xy @ beta, 0.0)
        sign, log_x = np.linalg.slogdet(x)
        return log_v + log_x, rss, beta, x

    def _profile(self, ratio: float):
        """REML criterion with the residual variance profiled out."""
        log_det, rss, beta, x = self._solve(ratio)
        sigma2 = rss / self._df
        value = log_det + self._df * (math.log(2.0 * math.pi * sigma2) + 1.0)
        return value, sigma2, beta, np.linalg.inv(x)

    def _slope(self, log_ratio: float) -> float:
        """Derivative of the profiled criterion in the log ratio."""
        ratio = math.exp(log_ratio)
        _, correction, log_slope, slope = self._products.at(ratio)
        correction = self._centring.T @ correction @ self._centring
        slope = self._centring.T @ slope @ self._centring
        pick = np.ix_(self._chosen, self._chosen)
        a, d = self._plain - correction[pick], -slope[pick]
        x, xy = a[:-1, :-1], a[:-1, -1]
        beta = np.linalg.solve(x, xy)
        rss = a[-1, -1] - xy @ beta
        moved = d[-1, -1] - 2.0 * beta @ d[:-1, -1] + beta @ d[:-1, :-1] @ beta
        return ratio * (log_slope + np.trace(np.linalg.solve(x, d[:-1, :-1]))
                        + self._df * moved / rss)

    def _search(self) -> float:
        """Coarse scan of the log ratio, then the root of the slope in the best bracket.

        The bracket is divided several times at once, as one pass serves many ratios, before
        single steps close in.
        """
        scan = np.linspace(math.log(1e-8), math.log(1e8), 33)
        self._products.prepare([math.exp(s) for s in scan])
        values = [self._profile(math.exp(s))[0] for s in scan]
        best = int(np.argmin(values))
        low, high = scan[max(best - 1, 0)], scan[min(best + 1, len(scan) - 1)]
        slope_low, slope_high = self._slope(low), self._slope(high)
        if slope_low >= 0.0:
            return 0.0
        for _ in range(2):
            if slope_high <= 0.0:
                break
            inner = np.linspace(low, high, 17)[1:-1]
            self._products.prepare([math.exp(s) for s in inner])
            for point in inner:
                slope = self._slope(point)
                if slope >= 0.0:
                    high, slope_high = point, slope
                    break
                low, slope_low = point, slope
        while slope_high > 0.0 and high - low > 1e-12:
            # Regula falsi, with a bisection step whenever it crowds one end.
            middle = low - slope_low * (high - low) / (slope_high - slope_low)
            margin = 0.02 * (high - low)
            middle = min(max(middle, low + margin), high - margin)
            # The root lies close to the estimate: its surroundings become the next bracket.
            points = sorted({middle - margin / 8, middle, middle + margin / 8})
            self._products.prepare([math.exp(s) for s in points])
            for point in points:
                slope = self._slope(point)
                if slope >= 0.0:
                    high, slope_high = point, slope
                    break
                low, slope_low = point, slope
        return math.exp(0.5 * (low + high))

    def _criterion(self, group_variance: float, sigma2: float) -> float:
        log_det, rss, _, _ = self._solve(group_variance / sigma2)
        return log_det + self._df * math.log(2.0 * math.pi * sigma2) + rss / sigma2

    def _covariance_at(self, group_variance: float, sigma2: float) -> np.ndarray:
        _, _, _, x = self._solve(group_variance / sigma2)
        return sigma2 * self._back @ np.linalg.inv(x) @ self._back.T

    def _variance_uncertainty(self):
        """Covariance of the two variances and the slopes of the coefficient covariance."""
        if self._variation is None:
            point = np.array([self.group_variance, self.sigma2])
            step = point * 1e-3
            hessian = np.empty((2, 2))
            moves = [(i * step[0], j * step[1]) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            self._products.prepare([(point[0] + a) / (point[1] + b) for a, b in moves])
            centre = self._criterion(*point)
            for i in range(2):
                e = np.eye(2)[i] * step
                hessian[i, i] = (self._criterion(*(point + e)) - 2.0 * centre
                                 + self._criterion(*(point - e))) / step[i] ** 2
            e, g = np.array([step[0], 0.0]), np.array([0.0, step[1]])
            hessian[0, 1] = hessian[1, 0] = (
                self._criterion(*(point + e + g)) - self._criterion(*(point + e - g))
                - self._criterion(*(point - e + g)) + self._criterion(*(point - e - g))
            ) / (4.0 * step[0] * step[1])
            slopes = [(self._covariance_at(*(point + d)) - self._covariance_at(*(point - d)))
                      / (2.0 * d.sum()) for d in (e, g)]
            self._variation = 2.0 * np.linalg.inv(hessian), slopes
        return self._variation

    def satterthwaite(self, row: np.ndarray) -> float:
        """Approximate degrees of freedom of a linear combination of the coefficients."""
        if self.ratio == 0.0:
            return float(self._df)
        spread, slopes = self._variance_uncertainty()
        l = row[self.kept]
        variance = l @ self.cov[np.ix_(self.kept, self.kept)] @ l
        gradient = np.array([l @ s @ l for s in slopes])
        return float(2.0 * variance**2 / (gradient @ spread @ gradient))

    def coefficients(self) -> DataFrame:
        rows = []
        for j, label in enumerate(self.design.labels):
            if j not in self.kept:
                rows.append((label, *[math.nan] * 5))
                continue
            df = self.satterthwaite(np.eye(len(self.beta))[j])
            se = math.sqrt(self.cov[j, j])
            t = self.beta[j] / se
            rows.append((label, self.beta[j], se, df, t, t_two_sided(t, df)))
        return table(self.spark, rows, "term string, estimate double, std_error double, "
                                       "df double, t_value double, p_value double")

    def variances(self) -> DataFrame:
        return table(
            self.spark,
            [(self.frame.n, self.n_groups, self.group_variance, self.sigma2, self.deviance)],
            "n long, n_groups long, group_variance double, residual_variance double, "
            "reml_criterion double")

    def anova(self, type: int = 3) -> DataFrame:
        """Wald chi-square of each term's coefficient block."""
        if type != 3:
            raise ValueError("only type 3 is offered")
        return wald_table(self.spark, self.design, self.kept, self.beta, self.cov)

    def emmeans(self, over: Sequence[str], level: float = 0.95) -> DataFrame:
        """Marginal means with Satterthwaite degrees of freedom."""
        return posthoc.emmeans_table(self.spark, self.design, over, self.frame.at, self.beta,
                                     self.cov, self.satterthwaite, level)

    def pairwise(self, over: Sequence[str], adjust: str = "tukey") -> DataFrame:
        return posthoc.pairwise_table(self.spark, self.design, over, self.frame.at, self.beta,
                                      self.cov, self.satterthwaite, adjust)


def wald_table(spark, design, kept, beta, cov) -> DataFrame:
    rows = []
    for i, name in enumerate(design.term_names):
        c = kept[np.isin(kept, design.columns_of(i))]
        if not len(c):
            continue
        chisq = float(beta[c] @ np.linalg.solve(cov[np.ix_(c, c)], beta[c]))
        rows.append((name, chisq, len(c), chi2_upper(chisq, len(c))))
    return table(spark, rows, "term string, chisq double, df long, p_value double")


def lmm(
    df: DataFrame, y: str, fixed: Sequence[Term], group: str, covariates: Sequence[str] = (),
    contrasts: str = "treatment", levels: Mapping[str, Sequence[Any]] | None = None,
) -> MixedFit:
    """Random intercept per ``group``; fixed terms as in a linear model."""
    source = model_rows(df, y, fixed, covariates, extra=[group])
    frame = frame_of(df.sparkSession, source, fixed, contrasts, levels)
    k = len(frame.design.labels)
    # Fitting around the overall mean keeps the cross-products well scaled.
    shift = float(frame.triangle[0, k] / frame.triangle[0, 0])
    sums = cell_sums(source, [f"__{group}"])
    products = _Products(_group_products(sums, f"__{group}", frame, shift), k + 1)
    return MixedFit(frame, products, products.n_groups, shift)
