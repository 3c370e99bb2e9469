"""Models against dense brute force, and the properties they must have."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from plotfield.models import (
    crossed, fit_band, glm_quasipoisson, glmm_binomial, linear_model, lmm, ols, path_model, terms,
    welch_t,
)
from plotfield.models import design as design_module, glm as glm_module, glmm as glmm_module, mixed as mixed_module
from plotfield.models._tails import (
    chi2_upper, f_upper, normal_two_sided, studentised_range_upper, t_quantile, t_two_sided,
)
from plotfield.models.design import Design
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 400
    pdf = pd.DataFrame({
        "b": rng.choice(["m", "s", "u"], n, p=[0.5, 0.3, 0.2]), "d": rng.choice(["x", "y"], n),
        "z": rng.normal(2000.0, 2.0, n), "g": rng.integers(0, 23, n)})
    pull = rng.normal(0, 1.5, 23)[pdf["g"]]
    pdf["y"] = ((pdf["b"] == "s") * 2.0 + (pdf["d"] == "y") * 1.0 + 0.3 * (pdf["z"] - 2000)
                + pull + rng.normal(0, 1, n))
    pdf["count"] = rng.poisson(np.exp(0.5 + 0.4 * (pdf["b"] == "s") + 0.1 * (pdf["d"] == "y"))).astype(float)
    chance = 1 / (1 + np.exp(-(0.3 + (pdf["b"] == "s") - (pdf["d"] == "y") + pull)))
    pdf["hit"] = (rng.random(n) < chance).astype(int)
    return pdf


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data).repartition(3).cache()


def coded(values, levels, kind):
    index = np.array([levels.index(v) for v in values])
    k = len(levels)
    matrix = np.eye(k)[:, 1:] if kind == "treatment" else np.vstack([np.eye(k - 1), -np.ones(k - 1)])
    return matrix[index]


def dense(pdf, term_list, covariates=(), kind="treatment"):
    """Design built row by row, independently of the library."""
    blocks, owner = [np.ones((len(pdf), 1))], [0]
    for i, term in enumerate(term_list, 1):
        block = np.ones((len(pdf), 1))
        for v in term:
            part = (pdf[[v]].to_numpy(float) if v in covariates
                    else coded(pdf[v], sorted(pdf[v].unique()), kind))
            block = (block[:, None, :] * part[:, :, None]).reshape(len(pdf), -1)
        blocks.append(block)
        owner += [i] * block.shape[1]
    return np.hstack(blocks), np.array(owner)


def rss(x, y):
    return float(np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2))


# Tails


def test_tails_against_known_values():
    assert t_two_sided(2.0, 10) == pytest.approx(0.0733880347707, rel=1e-9)
    assert t_two_sided(1.96, math.inf) == pytest.approx(0.0499957902, rel=1e-8)
    assert f_upper(3.0, 2, 20) == pytest.approx(0.0725381503, rel=1e-8)
    assert f_upper(4.0, 1, 7) == pytest.approx(t_two_sided(2.0, 7), rel=1e-12)
    assert chi2_upper(5.991464547, 2) == pytest.approx(0.05, rel=1e-8)
    assert chi2_upper(3.0, 1) == pytest.approx(normal_two_sided(3.0**0.5), rel=1e-12)
    assert t_quantile(0.95, 22) == pytest.approx(2.0738730679, rel=1e-9)
    assert studentised_range_upper(3.877676, 3, 10) == pytest.approx(0.05, abs=1e-4)
    for df in (3, 12, 200):
        assert studentised_range_upper(2**0.5 * 1.7, 2, df) == pytest.approx(t_two_sided(1.7, df), rel=1e-6)
    assert studentised_range_upper(3.6332, 4, math.inf) == pytest.approx(0.05, abs=1e-4)


# Simple tests


def test_welch_and_its_equal_groups_limit(spark, data, frame):
    a, b = data["y"][data["d"] == "x"], data["y"][data["d"] != "x"]
    va, vb = a.var() / len(a), b.var() / len(b)
    row = welch_t(frame, "y", F.col("d") == "x").first()
    assert row["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb), rel=1e-10)
    assert row["df"] == pytest.approx((va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)), rel=1e-10)
    assert row["p_value"] == pytest.approx(t_two_sided(row["t"], row["df"]))
    assert row["lower"] < a.mean() - b.mean() < row["upper"]
    single = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "d string, y double")
    assert welch_t(single, "y", F.col("d") == "x").first()["p_value"] is None


def test_regression_matches_dense(data, frame):
    slope, intercept = np.polyfit(data["z"] - 2000, data["y"], 1)
    row = ols(frame, "y", "z").first()
    assert row["slope"] == pytest.approx(slope, rel=1e-9)
    assert row["intercept"] == pytest.approx(intercept - 2000 * slope, rel=1e-8)
    assert row["f_value"] == pytest.approx(row["slope_t"] ** 2)
    assert ols(frame, "y", "z", by=["b"]).count() == 3
    band = fit_band(frame, "y", "z", n=5).toPandas().sort_values("x")
    assert np.allclose(band["fit"], row["intercept"] + row["slope"] * band["x"])
    assert ((band["lower"] < band["fit"]) & (band["fit"] < band["upper"])).all()
    assert band["x"].iloc[0] == data["z"].min() and band["x"].iloc[-1] == data["z"].max()


# Linear models


MODELS = [
    (crossed("b", "d"), ()),
    (terms(crossed("b", "d"), "z"), ("z",)),
    (crossed("b", "d", "z"), ("z",)),
]


def test_terms_are_ordered_and_merged():
    assert crossed("a", "b", "c")[3:] == [("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]
    assert terms(crossed("a", "b"), "c", crossed("c", "b"), "z") == [
        ("a",), ("b",), ("c",), ("z",), ("a", "b"), ("b", "c")]
    with pytest.raises(ValueError, match="lower-order"):
        Design([("a",), ("a", "b")], {"a": ["1", "2"], "b": ["1", "2"]}, [])


@pytest.mark.parametrize("term_list,covariates", MODELS)
@pytest.mark.parametrize("kind", ["treatment", "sum"])
def test_linear_model_matches_dense(data, frame, term_list, covariates, kind):
    fit = linear_model(frame, "y", term_list, covariates, contrasts=kind)
    x, owner = dense(data, term_list, covariates, kind)
    y = data["y"].to_numpy()
    assert fit.rss == pytest.approx(rss(x, y), rel=1e-9)
    centre = x.copy()
    beta = np.linalg.lstsq(centre, y, rcond=1e-15)[0]
    assert np.allclose(x @ fit.beta, x @ beta, atol=1e-6)
    s2 = fit.rss / (len(y) - x.shape[1])
    names = [":".join(t) for t in term_list]
    first = fit.anova(1).toPandas().set_index("term")
    second = fit.anova(2).toPandas().set_index("term")
    third = fit.anova(3).toPandas().set_index("term")
    for i, term in enumerate(term_list, 1):
        before = x[:, owner < i]
        assert first.loc[names[i - 1], "sum_sq"] == pytest.approx(
            rss(before, y) - rss(x[:, owner <= i], y), rel=1e-5, abs=1e-6)
        outside = [0] + [m for m, t in enumerate(term_list, 1) if m != i and not set(term) < set(t)]
        base = x[:, np.isin(owner, outside)]
        both = x[:, np.isin(owner, outside + [i])]
        assert second.loc[names[i - 1], "sum_sq"] == pytest.approx(
            rss(base, y) - rss(both, y), rel=1e-5, abs=1e-6)
        assert third.loc[names[i - 1], "f_value"] == pytest.approx(
            (rss(x[:, owner != i], y) - fit.rss) / (owner == i).sum() / s2, rel=1e-4, abs=1e-6)
    total = float(np.sum((y - y.mean()) ** 2))
    assert first["sum_sq"].sum() == pytest.approx(total, rel=1e-9)


def test_many_cells(spark):
    """200,000 cells: the fit equals the one from plain sums."""
    df = spark.range(400_000).select((F.col("id") % 200_000).cast("string").alias("unit"), (F.col("id") % 7).cast("double").alias("z"),
                                     (F.col("id") % 3 + F.col("id") % 7 * 0.5).cast("double").alias("y"), (F.col("id") % 2).cast("string").alias("b"))
    cells = df.groupBy("unit", "b", "z").agg(F.avg("y").alias("y"))
    assert cells.count() >= 200_000
    fit = linear_model(df, "y", terms("b", "z"), ["z"])
    pdf = df.select("b", "z", "y").toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf["b"] == "1", pdf["z"]]).astype(float)
    assert np.allclose(fit.beta, np.linalg.lstsq(x, pdf["y"], rcond=None)[0], atol=1e-8)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_partitioning_does_not_matter(frame, partitions):
    fit = linear_model(frame.repartition(partitions), "y", crossed("b", "d"))
    assert fit.rss == pytest.approx(linear_model(frame, "y", crossed("b", "d")).rss, rel=1e-12)


def test_the_driver_gets_one_triangle_of_more_partitions_than_slots(spark, monkeypatch):
    monkeypatch.setattr(design_module, "SLOTS", 3)
    cells = spark.range(60).select(F.col("id").cast("double").alias("v")).repartition(20)

    def rows_of(part):
        v = part["v"].to_numpy()
        return {m: (np.column_stack([np.ones(len(v)), v + m]), np.array([len(v), v.sum()])) for m in (0, 5)}

    found = design_module.reduce_triangles(cells, rows_of)
    x = np.arange(60.0)
    for m in (0, 5):
        r, totals = found[m]
        dense = np.column_stack([np.ones(60), x + m])
        assert r.shape == (2, 2) and np.allclose(r.T @ r, dense.T @ dense)
        assert totals.tolist() == [60.0, x.sum()]
    with pytest.raises(ValueError, match="no complete rows"):
        design_module.reduce_triangles(cells.where("v < 0"), rows_of)


def test_types_agree_on_balanced_data_with_sum_coding(spark):
    rng = np.random.default_rng(2)
    grid = list(itertools.product("ABC", "xy", range(4)))
    df = spark.createDataFrame([(a, b, float(rng.normal())) for a, b, _ in grid], "a string, b string, y double")
    fit = linear_model(df, "y", crossed("a", "b"), contrasts="sum")
    one, two = fit.anova(1).toPandas(), fit.anova(2).toPandas()
    three = fit.anova(3).where("term <> '(Intercept)'").toPandas()
    assert np.allclose(one["sum_sq"], two["sum_sq"]) and np.allclose(one["sum_sq"], three["sum_sq"])


def test_oneway_f_is_t_squared(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 9), rng.normal(1, 1, 9)])
    values[9:] = values[9:].mean() + (values[:9] - values[:9].mean())
    df = spark.createDataFrame([("a" if i < 9 else "b", float(v)) for i, v in enumerate(values)], "g string, y double")
    f = linear_model(df, "y", crossed("g")).anova(1).first()["f_value"]
    assert f == pytest.approx(welch_t(df, "y", F.col("g") == "a").first()["t"] ** 2, rel=1e-9)


def test_aliased_columns_are_dropped(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 4.0), ("a", "x", 1.5)],
                               "a string, b string, y double")
    fit = linear_model(df, "y", crossed("a", "b"))
    assert np.isnan(fit.beta[-1]) and fit.df_resid == 1
    assert "a:b" not in [r["term"] for r in fit.anova(1).collect()]
    with pytest.raises(ValueError, match="empty cells"):
        fit.emmeans(["a"])


def test_missing_rows_levels_and_bad_input(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", None), (None, 9.0), ("a", 2.0)], "g string, y double")
    fit = linear_model(df, "y", crossed("g"), levels={"g": ["b", "a", "never"]})
    assert fit.frame.n == 3 and fit.design.labels == ["(Intercept)", "ga"]
    assert fit.beta[0] == pytest.approx(3.0)
    with pytest.raises(ValueError, match="no such columns"):
        linear_model(df, "y", crossed("absent"))
    with pytest.raises(ValueError, match="fewer than two"):
        linear_model(df.where("g = 'a'"), "y", crossed("g"))
    with pytest.raises(ValueError, match="no complete rows"):
        linear_model(df.where("y > 100"), "y", crossed("g"))


def test_numeric_factor_levels_sort_as_numbers(spark):
    df = spark.createDataFrame([(i, float(i)) for i in (2, 10, 9, 2, 10, 9)], "p int, y double")
    assert linear_model(df, "y", crossed("p")).design.levels["p"] == ["2", "9", "10"]


def test_marginal_means_weight_cells_equally(data, frame):
    fit = linear_model(frame, "y", crossed("b", "d"))
    cells = data.groupby(["b", "d"])["y"].mean().unstack().mean(axis=1)
    means = fit.emmeans(["b"]).toPandas().set_index("b")
    assert np.allclose(means["emmean"], cells[means.index])
    pairs = fit.pairwise(["b"]).toPandas().set_index("contrast")
    assert pairs.loc["m - s", "estimate"] == pytest.approx(cells["m"] - cells["s"])
    raw = fit.pairwise(["b"], adjust="none").toPandas().set_index("contrast")
    assert (raw["p_value"] <= pairs["p_value"] + 1e-12).all()
    two = fit.pairwise(["d"]).first()
    assert two["p_value"] == pytest.approx(t_two_sided(two["t_ratio"], fit.df_resid), rel=1e-5)


# Quasi-Poisson


def test_quasi_poisson_factorial_reproduces_cells(data, frame):
    fit = glm_quasipoisson(frame, "count", crossed("b", "d"))
    cells = data.groupby(["b", "d"])["count"].transform("mean")
    pearson = (((data["count"] - cells) ** 2) / cells).sum()
    assert fit.dispersion == pytest.approx(pearson / (len(data) - 6), rel=1e-9)
    logs = np.log(data.groupby(["b", "d"])["count"].mean()).unstack().mean(axis=1)
    means = fit.emmeans(["b"]).toPandas().set_index("b")
    assert np.allclose(means["emmean"], logs[means.index])


def test_quasi_poisson_likelihood_ratios_match_dense(data, frame):
    def deviance(x):
        beta = np.zeros(x.shape[1])
        beta[0] = math.log(y.mean())
        for _ in range(50):
            mu = np.exp(x @ beta)
            beta = beta + np.linalg.solve((x * mu[:, None]).T @ x, x.T @ (y - mu))
        mu = np.exp(x @ beta)
        return 2 * np.sum(np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))

    y = data["count"].to_numpy()
    scaled = data.assign(z=data["z"] - 2000)
    fit = glm_quasipoisson(frame.withColumn("z", F.col("z") - 2000), "count", terms(crossed("b", "d"), "z"), ["z"])
    x, owner = dense(scaled, terms(crossed("b", "d"), "z"), ("z",))
    assert fit.deviance == pytest.approx(deviance(x), rel=1e-8)
    table = fit.anova(3).toPandas()
    for i, term in enumerate(terms(crossed("b", "d"), "z"), 1):
        row = table[table["term"] == ":".join(term)].iloc[0]
        assert row["lr_chisq"] == pytest.approx(
            (deviance(x[:, owner != i]) - deviance(x)) / fit.dispersion, rel=1e-5, abs=1e-6)


def test_unconverged_fits_fail(frame, monkeypatch):
    monkeypatch.setattr(glm_module, "MAX_STEPS", 1)
    with pytest.raises(RuntimeError, match="not converged"):
        glm_quasipoisson(frame, "count", crossed("b", "d"))
    monkeypatch.setattr(glmm_module, "MODE_STEPS", 1)
    with pytest.raises(Exception, match="not converged"):
        glmm_binomial(frame, "hit", crossed("b"), "g")


# Mixed models


def reml(theta, x, y, groups):
    """Dense REML criterion for a variance ratio."""
    z = (groups[:, None] == np.unique(groups)[None, :]).astype(float)
    v = np.eye(len(y)) + theta * z @ z.T
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    r = y - x @ beta
    df = len(y) - x.shape[1]
    s2 = r @ vi @ r / df
    return (np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + df * (math.log(2 * math.pi * s2) + 1),
            s2, beta, s2 * np.linalg.inv(a))


@pytest.mark.parametrize("covariates", [(), ("z",)])
def test_mixed_model_matches_dense_reml(data, frame, covariates):
    term_list = terms(crossed("b", "d"), *covariates)
    fit = lmm(frame, "y", term_list, "g", covariates, contrasts="sum")
    x, owner = dense(data, term_list, covariates, "sum")
    value, s2, beta, cov = reml(fit.ratio, x, data["y"].to_numpy(), data["g"].to_numpy())
    assert fit.deviance == pytest.approx(value, rel=1e-9)
    assert fit.sigma2 == pytest.approx(s2, rel=1e-7)
    assert np.allclose(fit.beta, beta, rtol=1e-5, atol=1e-5)
    assert np.allclose(np.sqrt(np.diag(fit.cov)), np.sqrt(np.diag(cov)), rtol=1e-5)
    for nudge in (0.98, 1.02):
        assert reml(fit.ratio * nudge, x, data["y"].to_numpy(), data["g"].to_numpy())[0] > value
    table = fit.anova(3).toPandas().set_index("term")
    block = np.flatnonzero(owner == 1)
    assert table.loc["b", "chisq"] == pytest.approx(
        beta[block] @ np.linalg.solve(cov[np.ix_(block, block)], beta[block]), rel=1e-5)


def test_ratios_in_one_pass_or_in_several(frame):
    products = lmm(frame, "y", crossed("b", "d"), "g", contrasts="sum")._products
    together = mixed_module._Products(products._entries, products._width)
    together.prepare([0.1, 1.0, 10.0])
    for ratio in (0.1, 1.0, 10.0):
        for a, b in zip(products.at(ratio), together.at(ratio)):
            assert np.allclose(a, b, rtol=1e-12)


def test_balanced_mixed_model_has_anova_estimators(spark):
    rng = np.random.default_rng(8)
    pull = rng.normal(0, 2, 12)
    table = np.array([[pull[g] + e + rng.normal() for e in (0.0, 1.0)] for g in range(12)])
    df = spark.createDataFrame([(g, "ab"[e], float(table[g, e])) for g in range(12) for e in (0, 1)],
                               "g int, e string, y double")
    fit = lmm(df, "y", crossed("e"), "g", contrasts="sum")
    gap = table[:, 0] - table[:, 1]
    mse, msg = gap.var(ddof=1) / 2, 2 * table.mean(axis=1).var(ddof=1)
    assert fit.sigma2 == pytest.approx(mse, rel=1e-7)
    assert fit.group_variance == pytest.approx((msg - mse) / 2, rel=1e-7)
    assert fit.coefficients().toPandas()["df"].tolist() == pytest.approx([11.0, 11.0], rel=1e-4)
    assert fit.pairwise(["e"]).first()["df"] == pytest.approx(11.0, rel=1e-4)


def test_no_group_variance_is_ordinary_regression(spark):
    df = spark.createDataFrame([(g, e, float(v)) for g in range(4) for e, v in
                                (("a", 1 + g % 2), ("a", 2 - g % 2), ("b", 4), ("b", 5))],
                               "g int, e string, y double")
    fit, plain = lmm(df, "y", crossed("e"), "g"), linear_model(df, "y", crossed("e"))
    assert fit.ratio == 0.0 and fit.sigma2 == pytest.approx(plain.sigma2)
    assert np.allclose(fit.cov, plain.cov) and fit.satterthwaite(np.array([0.0, 1.0])) == plain.df_resid


# Binomial mixed model


def laplace(theta, beta, x, y, groups):
    """Dense Laplace deviance, one group at a time, by bisection for each mode."""
    total = 0.0
    for g in np.unique(groups):
        xb, yy = x[groups == g] @ beta, y[groups == g]

        def slope(u):
            return theta * np.sum(yy - 1 / (1 + np.exp(-(xb + theta * u)))) - u

        low, high = -50.0, 50.0
        for _ in range(200):
            mid = 0.5 * (low + high)
            low, high = (mid, high) if slope(mid) > 0 else (low, mid)
        eta = xb + theta * low
        p = 1 / (1 + np.exp(-eta))
        total += (-2 * np.sum(yy * eta - np.log1p(np.exp(eta))) + low**2
                  + math.log(1 + theta**2 * np.sum(p * (1 - p))))
    return total


def test_binomial_mixed_model_is_the_laplace_optimum(data, frame):
    fit = glmm_binomial(frame, "hit", crossed("b", "d"), "g")
    x, _ = dense(data, crossed("b", "d"))
    args = (x, data["hit"].to_numpy(float), data["g"].to_numpy())
    best = laplace(fit.group_sd, fit.beta, *args)
    assert fit.deviance == pytest.approx(best, rel=1e-9)
    for j in range(len(fit.beta)):
        for sign in (-0.02, 0.02):
            moved = fit.beta + sign * np.eye(len(fit.beta))[j]
            assert laplace(fit.group_sd, moved, *args) > best
    for nudge in (0.97, 1.03):
        assert laplace(fit.group_sd * nudge, fit.beta, *args) > best


def test_binomial_gradient_and_spark_evaluation(frame):
    fit = glmm_binomial(frame, "hit", terms(crossed("b", "d"), "z"), "g", ["z"])
    assert abs(fit.beta[4]) < 1.0
    local = fit.objective
    beta = np.linspace(-0.2, 0.3, len(fit.beta))
    value, gradient = local.evaluate((0.8, beta))[0]
    step = 1e-5
    for j in range(len(beta) + 1):
        d, e = (step, 0) if j == 0 else (0, step * np.eye(len(beta))[j - 1])
        up, down = local.evaluate((0.8 + d, beta + e), (0.8 - d, beta - e))
        slope = (up[0] - down[0]) / (2 * step)
        assert slope == pytest.approx(gradient[j], rel=1e-5, abs=1e-5)


def test_binomial_hot_group(spark):
    """4,000 rows in 12 groups, one of which holds a third; any partitioning gives the same fit."""
    rng = np.random.default_rng(4)
    g = np.where(np.arange(4000) % 3 == 0, 0, 1 + np.arange(4000) % 11)
    x = np.arange(4000) % 2
    hit = rng.random(4000) < 1 / (1 + np.exp(-(0.4 * x - 0.3 + np.linspace(-1, 1, 12)[g])))
    df = spark.createDataFrame(list(zip(g.tolist(), map("ab".__getitem__, x.tolist()), hit.astype(int).tolist())), "g int, e string, h int")
    a, b = (glmm_binomial(frame, "h", crossed("e"), "g") for frame in (df.coalesce(1), df.repartition(9)))
    assert a.objective.groups == 12 and np.allclose(a.beta, b.beta, atol=1e-5) and a.group_sd == pytest.approx(b.group_sd, rel=1e-4)


def test_binomial_without_group_variance_is_a_plain_logit(spark):
    rows = [(g, e, i < k) for g in range(6) for e, k in (("a", 3), ("b", 6)) for i in range(10)]
    df = spark.createDataFrame([(g, e, int(h)) for g, e, h in rows], "g int, e string, h int")
    fit = glmm_binomial(df, "h", crossed("e"), "g")
    assert fit.group_sd < 1e-3
    assert fit.beta[0] == pytest.approx(math.log(3 / 7), abs=1e-5)
    assert fit.beta[1] == pytest.approx(math.log(6 / 4) - math.log(3 / 7), abs=1e-5)


# Paths


EQUATIONS = {"m": ["x"], "o": ["m", "x"]}


@pytest.fixture(scope="module")
def chain(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    m = 0.7 * x + rng.normal(size=60)
    o = -0.4 * m + 0.2 * x + rng.normal(size=60)
    pdf = pd.DataFrame({"x": x, "m": m, "o": o})
    return pdf, spark.createDataFrame(pdf)


def test_paths_are_equationwise_least_squares(chain):
    pdf, df = chain
    fit = path_model(df, EQUATIONS)
    x = np.column_stack([np.ones(60), pdf["m"], pdf["x"]])
    beta = np.linalg.lstsq(x, pdf["o"], rcond=None)[0]
    psi = rss(x, pdf["o"].to_numpy()) / 60
    rows = {(r["lhs"], r["op"], r["rhs"]): r for r in fit.coefficients().collect()}
    assert rows["o", "~", "m"]["estimate"] == pytest.approx(beta[1])
    assert rows["o", "~", "m"]["se"] == pytest.approx(math.sqrt(psi * np.linalg.inv(x.T @ x)[1, 1]))
    assert rows["o", "~~", "o"]["estimate"] == pytest.approx(psi)
    assert rows["o", "~1", ""]["estimate"] == pytest.approx(beta[0])
    total = fit.effects({"total": [[("o", "x")], [("o", "m"), ("m", "x")]]}).first()
    assert total["estimate"] == pytest.approx(np.polyfit(pdf["x"], pdf["o"], 1)[0])
    stats = fit.fit().first()
    assert stats["df"] == 0 and stats["chisq"] == pytest.approx(0.0, abs=1e-9) and stats["cfi"] == 1.0


def test_fixed_variance_gives_the_only_misfit(chain):
    pdf, df = chain
    equations = {"m": ["x"], "o": ["x"]}
    s = pdf["x"].var(ddof=0)
    stats = path_model(df, equations, fixed_var={"x": 1.0}).fit().first()
    assert stats["df"] == 1
    assert stats["chisq"] == pytest.approx(60 * (s - math.log(s) - 1), rel=1e-8)
    rows = {(r["lhs"], r["op"], r["rhs"]): r for r in path_model(df, equations).coefficients().collect()}
    assert ("m", "~~", "o") in rows
    bare = path_model(df, equations, residual_cov="none").fit().first()
    assert bare["df"] == 1 and bare["chisq"] > 0


def test_paths_reject_loops_and_unequal_outcomes(chain):
    _, df = chain
    with pytest.raises(ValueError, match="recursive"):
        path_model(df, {"m": ["o"], "o": ["m"]})
    with pytest.raises(ValueError, match="different predictors"):
        path_model(df.withColumn("w", F.col("x") + F.col("m")), {"m": ["x"], "o": ["x", "w"]})


def test_tails_can_be_sent_after_use():
    """The package is sent to the executors by value, also after the driver has computed a tail."""
    from pyspark import cloudpickle

    from plotfield.models import _tails
    first = _tails.studentised_range_upper(3.5, 4, 20.0)
    assert cloudpickle.loads(cloudpickle.dumps(_tails.studentised_range_upper))(3.5, 4, 20.0) == first
