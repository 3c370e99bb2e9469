"""Design matrices over aggregated cells.

A model never sees rows. Spark groups them into cells, one per combination of factor
levels, and keeps for each the row count, the means and the co-moments of the covariates
and the response. Every design column is a factor coding, constant within a cell, times a
product of covariates, so a cell can be replaced by a few weighted pseudo-rows with exactly
the same sufficient statistics. Their triangular (QR) factor is all that model fitting
needs; working from it avoids squaring the condition number, which matters for covariates
such as calendar years.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, product
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType

Term = tuple[str, ...]

#: Tasks that stack the partitions' triangles.
SLOTS = 64


def crossed(*names: str) -> list[Term]:
    """Main effects and all interactions of the names."""
    return [c for size in range(1, len(names) + 1) for c in combinations(names, size)]


def terms(*parts: str | Term | Sequence[Term]) -> list[Term]:
    """Merge terms: repeated ones once, lower order first, variables in order of appearance."""
    flat: list[Term] = []
    for part in parts:
        if isinstance(part, str):
            flat.append((part,))
        elif isinstance(part, tuple) and all(isinstance(x, str) for x in part):
            flat.append(part)
        else:
            flat.extend(part)
    variables = list(dict.fromkeys(v for t in flat for v in t))
    unique = {frozenset(t): tuple(sorted(t, key=variables.index)) for t in flat}
    return sorted(unique.values(), key=len)


def coding(n_levels: int, kind: str) -> np.ndarray:
    """Contrast columns: ``treatment`` (first level is the baseline) or ``sum`` (last is -1)."""
    if kind == "treatment":
        return np.eye(n_levels)[:, 1:]
    if kind == "sum":
        return np.vstack([np.eye(n_levels - 1), -np.ones((1, n_levels - 1))])
    raise ValueError("contrasts are 'treatment' or 'sum'")


@dataclass
class Design:
    terms: list[Term]
    levels: dict[str, list[str]]
    covariates: list[str]
    contrasts: str = "treatment"
    labels: list[str] = field(init=False)
    owner: np.ndarray = field(init=False)
    parts: list[tuple[dict[str, int], Term]] = field(init=False)

    def __post_init__(self) -> None:
        have = {frozenset(t) for t in self.terms}
        for t in self.terms:
            lower = [c for c in combinations(t, len(t) - 1) if c]
            if any(frozenset(c) not in have for c in lower):
                raise ValueError(f"{':'.join(t)} needs all its lower-order terms")
        for name, values in self.levels.items():
            if len(values) < 2:
                raise ValueError(f"factor {name} has fewer than two levels: {values}")
        self.codings = {f: coding(len(v), self.contrasts) for f, v in self.levels.items()}
        self.labels, self.parts, owner = ["(Intercept)"], [({}, ())], [0]
        for i, term in enumerate(self.terms, start=1):
            factors = [v for v in term if v in self.levels]
            monomial = tuple(v for v in term if v not in self.levels)
            sizes = [range(self.codings[f].shape[1]) for f in factors]
            for picked in product(*reversed(sizes)):
                choice = dict(zip(factors, reversed(picked)))
                self.parts.append((choice, monomial))
                self.labels.append(":".join(
                    f"{v}{self._suffix(v, choice[v])}" if v in choice else v for v in term))
                owner.append(i)
        self.owner = np.array(owner)

    def _suffix(self, factor: str, j: int) -> str:
        return self.levels[factor][j + 1] if self.contrasts == "treatment" else str(j + 1)

    @property
    def factors(self) -> list[str]:
        return list(self.levels)

    @property
    def monomials(self) -> list[Term]:
        return monomials_of(self.terms, self.covariates)

    @property
    def term_names(self) -> list[str]:
        return ["(Intercept)"] + [":".join(t) for t in self.terms]

    def columns_of(self, term: int) -> np.ndarray:
        return np.flatnonzero(self.owner == term)

    def factor_part(self, cells: pd.DataFrame) -> np.ndarray:
        """Factor codings of each cell, one column per design column."""
        codes = {f: pd.Categorical(cells[f].astype(str), categories=v).codes
                 for f, v in self.levels.items()}
        out = np.ones((len(cells), len(self.labels)))
        for c, (choice, _) in enumerate(self.parts):
            for f, j in choice.items():
                out[:, c] *= self.codings[f][codes[f], j]
        return out

    def rows(self, cells: pd.DataFrame) -> np.ndarray:
        """Design rows where each covariate has its own column in ``cells``."""
        out = self.factor_part(cells)
        for c, (_, monomial) in enumerate(self.parts):
            for v in monomial:
                out[:, c] *= cells[v].to_numpy(float)
        return out

    def coded(self, choice: Mapping[str, int]) -> Column:
        """Factor part of a design column as a Spark expression over the factor columns."""
        value = F.lit(1.0)
        for f, j in choice.items():
            pairs = zip(self.levels[f], self.codings[f][:, j])
            codes = [F.lit(x) for level, code in pairs for x in (level, float(code))]
            value = value * F.element_at(F.create_map(*codes), F.col(f))
        return value

    def expressions(self) -> list[Column]:
        """Design columns as Spark expressions over the predictor columns."""
        return [reduce(lambda value, v: value * F.col(v), monomial, self.coded(choice))
                for choice, monomial in self.parts]

    def centring(self, at: Mapping[str, float]) -> np.ndarray:
        """Matrix ``C`` with ``X @ C`` the design over covariates centred at ``at``.

        Coefficients of the centred design, multiplied by ``C``, are those of the raw one.
        """
        place = {(tuple(sorted(c.items())), frozenset(m)): j for j, (c, m) in enumerate(self.parts)}
        raw = np.eye(len(self.labels))
        for j, (choice, monomial) in enumerate(self.parts):
            for size in range(len(monomial)):
                for kept in combinations(monomial, size):
                    i = place[tuple(sorted(choice.items())), frozenset(kept)]
                    raw[i, j] = np.prod([at[v] for v in monomial if v not in kept])
        return np.linalg.inv(raw)

    def means_over(self, over: Sequence[str], at: Mapping[str, float]) -> tuple[list, np.ndarray]:
        """Rows of the reference grid: ``over`` levels, equal weight on other factors."""
        combos = list(product(*[range(len(self.levels[f])) for f in over]))
        out = np.ones((len(combos), len(self.labels)))
        for c, (choice, monomial) in enumerate(self.parts):
            out[:, c] *= np.prod([at[v] for v in monomial]) if monomial else 1.0
            for f, j in choice.items():
                column = self.codings[f][:, j]
                out[:, c] *= ([column[combo[list(over).index(f)]] for combo in combos]
                              if f in over else column.mean())
        names = [tuple(self.levels[f][i] for f, i in zip(over, combo)) for combo in combos]
        return names, out


def monomials_of(term_list: Sequence[Term], covariates: Sequence[str]) -> list[Term]:
    found = [tuple(v for v in t if v in covariates) for t in term_list]
    return list(dict.fromkeys(m for m in found if m))


def order_levels(values: Sequence[str], numeric: bool) -> list[str]:
    return sorted(values, key=(lambda v: float(v)) if numeric else None)


@dataclass
class Source:
    """The complete rows of a model frame, not yet aggregated."""

    df: DataFrame
    factors: list[str]
    covariates: list[str]
    monomials: list[Term]
    numeric_factors: set[str]


def model_rows(
    df: DataFrame, y: str, term_list: Sequence[Term], covariates: Sequence[str],
    extra: Sequence[str] = (),
) -> Source:
    """Columns a model uses, typed, without rows that lack any of them."""
    variables = list(dict.fromkeys(v for t in term_list for v in t))
    unknown = [v for v in [y, *variables, *extra] if v not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    factors = [v for v in variables if v not in covariates]
    used = [v for v in variables if v in covariates]
    kept = df.select(
        *[F.col(f).cast("string").alias(f) for f in factors],
        *[F.col(c).cast("double").alias(c) for c in used],
        *[F.col(e).cast("string").alias(f"__{e}") for e in extra],
        F.col(y).cast("double").alias("__y"),
    ).dropna()
    numeric = {f for f in factors if isinstance(df.schema[f].dataType, NumericType)}
    return Source(kept, factors, used, monomials_of(term_list, used), numeric)


def _measures(source: Source) -> list:
    columns = []
    for monomial in source.monomials:
        value = F.col(monomial[0])
        for v in monomial[1:]:
            value = value * F.col(v)
        columns.append(value)
    return [*columns, F.col("__y")]


def cell_moments(source: Source) -> DataFrame:
    """One row per factor combination: size, means and co-moments. Combined on the map side."""
    measures = _measures(source)
    aggregates = [F.count(F.lit(1)).cast("double").alias("__n")]
    aggregates += [F.avg(m).alias(f"__m{i}") for i, m in enumerate(measures)]
    aggregates += [F.covar_pop(measures[i], measures[j]).alias(f"__c{i}_{j}")
                   for i in range(len(measures)) for j in range(i, len(measures))]
    return source.df.groupBy(*source.factors).agg(*aggregates)


def cell_sums(source: Source, extra: Sequence[str]) -> DataFrame:
    """Per ``extra`` key and factor combination: size and sums of the measures."""
    return source.df.groupBy(*extra, *source.factors).agg(
        F.count(F.lit(1)).cast("double").alias("__n"),
        *[F.sum(m).alias(f"__s{i}") for i, m in enumerate(_measures(source))])


def find_levels(
    source: Source, cells: DataFrame, declared: Mapping[str, Sequence[Any]]
) -> dict[str, list[str]]:
    """Observed levels of each factor, in declared or sorted order, from one aggregation."""
    if not source.factors:
        return {}
    seen = cells.agg(*[F.collect_set(f) for f in source.factors]).first()
    found = {}
    if not all(seen):
        raise ValueError("no complete rows to fit")
    for f, values in zip(source.factors, seen):
        if f in declared:
            found[f] = [str(v) for v in declared[f] if str(v) in set(values)]
        else:
            found[f] = order_levels(set(values), f in source.numeric_factors)
    return found


def pseudo_rows(cells: pd.DataFrame, design: Design) -> np.ndarray:
    """Weighted rows ``[X | y]`` with the cells' exact sufficient statistics."""
    monomials = design.monomials
    q = len(monomials) + 1
    n = cells["__n"].to_numpy(float)
    fixed = design.factor_part(cells)
    which = [monomials.index(m) if m else -1 for _, m in design.parts]
    means = np.column_stack([cells[f"__m{i}"].to_numpy(float) for i in range(q)])
    scatter = np.zeros((len(cells), q, q))
    for i in range(q):
        for j in range(i, q):
            scatter[:, i, j] = scatter[:, j, i] = cells[f"__c{i}_{j}"].to_numpy(float)
    values, vectors = np.linalg.eigh(scatter)
    roots = np.sqrt(np.clip(values, 0.0, None) * n[:, None])
    inner = roots[:, :, None] * np.transpose(vectors, (0, 2, 1))

    def expand(measured: np.ndarray, constant: float) -> np.ndarray:
        columns = [measured[:, w] if w >= 0 else np.full(len(cells), constant) for w in which]
        return np.column_stack([fixed * np.column_stack(columns), measured[:, q - 1]])

    blocks = [expand(means, 1.0) * np.sqrt(n)[:, None]]
    blocks += [expand(inner[:, r, :], 0.0) for r in range(q)]
    return np.vstack(blocks)


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _add(held: dict[int, list], model: int, rows: np.ndarray, totals: Any) -> None:
    """Stack rows on a model's triangle and add to its totals."""
    own = held.setdefault(model, [None, 0.0])
    if len(rows):
        own[0] = triangle(rows if own[0] is None else np.vstack([own[0], rows]))
    own[1] = own[1] + totals


def _emit(held: dict[int, list], slot: int):
    for model, (partial, sums) in held.items():
        rows = [] if partial is None else [r.tolist() for r in partial]
        yield pd.DataFrame({
            "model": model, "slot": slot, "total": [False] * len(rows) + [True],
            "row": [*rows, np.atleast_1d(sums).tolist()]})


def _merge(batches):
    held: dict[int, list] = {}
    slot = 0
    for batch in batches:
        for (model, slot), part in batch.groupby(["model", "slot"]):
            rows = part.loc[~part["total"], "row"].tolist()
            _add(held, model, np.array(rows), sum(part.loc[part["total"], "row"], np.float64(0.0)))
    yield from _emit(held, slot)


def reduce_triangles(
    cells: DataFrame, rows_of: Callable[[pd.DataFrame], Mapping[int, tuple[np.ndarray, np.ndarray]]],
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each model: the triangular factor of its rows, and the sums of its totals, as ``rows_of(cells)`` gives them.

    One pass serves all models. Each partition reduces its own cells, as they lie, to one small
    triangle a model; these are stacked in up to ``SLOTS`` tasks and then in one, so that the driver
    gets one triangle a model however many partitions there are.
    """
    def per_partition(batches):
        held: dict[int, list] = {}
        for batch in batches:
            if len(batch):
                for model, (rows, totals) in rows_of(batch).items():
                    _add(held, model, rows, totals)
        yield from _emit(held, TaskContext.get().partitionId() % SLOTS)

    kind = "model int, slot int, total boolean, row array<double>"
    stacked = cells.mapInPandas(per_partition, kind).repartition("slot").mapInPandas(_merge, kind)
    found: dict[int, list] = {}
    for r in stacked.repartition(1).mapInPandas(_merge, kind).collect():
        found.setdefault(r.model, [[], None])
        if r.total:
            found[r.model][1] = np.array(r.row)
        else:
            found[r.model][0].append(r.row)
    if not found:
        raise ValueError("no complete rows to fit")
    return {model: (np.array(rows), totals) for model, (rows, totals) in found.items()}


def reduce_triangle(
    cells: DataFrame, rows_of: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray]:
    """:func:`reduce_triangles` of one model."""
    return reduce_triangles(cells, lambda part: {0: rows_of(part)})[0]


@dataclass
class Frame:
    """Everything a linear fit needs: design, triangle, size, and the cell table."""

    spark: SparkSession
    design: Design
    triangle: np.ndarray
    n: int
    cells: DataFrame
    at: dict[str, float]


def model_frame(
    df: DataFrame, y: str, term_list: Sequence[Term], covariates: Sequence[str] = (),
    contrasts: str = "treatment", levels: Mapping[str, Sequence[Any]] | None = None,
) -> Frame:
    source = model_rows(df, y, term_list, covariates)
    return frame_of(df.sparkSession, source, term_list, contrasts, levels)


def frame_of(
    spark: SparkSession, source: Source, term_list: Sequence[Term], contrasts: str,
    levels: Mapping[str, Sequence[Any]] | None, cells: DataFrame | None = None,
) -> Frame:
    cells = cell_moments(source).persist() if cells is None else cells
    design = Design(list(term_list), find_levels(source, cells, levels or {}), source.covariates,
                    contrasts)
    q = len(design.monomials)

    def rows_of(part: pd.DataFrame):
        n = part["__n"].to_numpy(float)
        means = np.array([part[f"__m{i}"].to_numpy(float) for i in range(q)]).reshape(q, len(n))
        return pseudo_rows(part, design), np.concatenate([[n.sum()], means @ n])

    r, totals = reduce_triangle(cells, rows_of)
    at = {m[0]: totals[1 + i] / totals[0] for i, m in enumerate(design.monomials) if len(m) == 1}
    return Frame(spark, design, r, int(round(totals[0])), cells, at)
