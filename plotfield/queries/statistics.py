"""Queries for tests and models. Their SQL states the closed form where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotfield.functions import water_year
from plotfield.models import (
    crossed, fit_band, glm_quasipoisson, glmm_binomial, linear_model, lmm, ols, path_model, terms,
    welch_t,
)
from plotfield.queries.registry import query, rounded, sql_rounded, with_rounded
from plotfield.queries.tables import BURN_SQL, PLOTS_SQL, individuals, plots, with_treatments


#: Two-sided critical value of t at 95 % for many degrees of freedom: the normal value and its expansion in 1 / df.
_Z = 1.959963984540054
_T_CRITICAL_SQL = "(" + " + ".join(
    f"{sum(c * _Z ** k for k, c in terms_.items()) / scale!r} / pow({{df}}, {order})" for order, (scale, terms_) in enumerate([
        (1, {1: 1}), (4, {3: 1, 1: 1}), (96, {5: 5, 3: 16, 1: 3}), (384, {7: 3, 5: 19, 3: 17, 1: -15}),
        (92160, {9: 79, 7: 776, 5: 1482, 3: -1920, 1: -945})])) + ")"


def _central_sql(t: str, density: str) -> str:
    """The area of an even density over ``x`` between -t and t, by Simpson's rule on 4,000 steps."""
    return (f"(SELECT 2 * ({t}) / 4000 / 3 * sum(w * ({density})) FROM (SELECT i / 4000.0::DOUBLE * ({t}) AS x, "
            "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM (SELECT unnest(range(4001)) AS i)))")


_T_DENSITY_SQL = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + x * x / df, -(df + 1) / 2)"


@query(f"""WITH {PLOTS_SQL},
s AS (SELECT avg("Biomass") FILTER ("Exclosure" = 'F') AS m1, avg("Biomass") FILTER ("Exclosure" <> 'F') AS m2,
  var_samp("Biomass") FILTER ("Exclosure" = 'F') / count(*) FILTER ("Exclosure" = 'F') AS a,
  var_samp("Biomass") FILTER ("Exclosure" <> 'F') / count(*) FILTER ("Exclosure" <> 'F') AS b,
  count(*) FILTER ("Exclosure" = 'F') AS n1, count(*) FILTER ("Exclosure" <> 'F') AS n2 FROM plots),
u AS (SELECT *, (m1 - m2) / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS df FROM s)
SELECT {sql_rounded('m1')} AS "mean_1", {sql_rounded('m2')} AS "mean_2", {sql_rounded('t')} AS "t", {sql_rounded('df', 4)} AS "df",
  {sql_rounded('1 - ' + _central_sql('abs(t)', _T_DENSITY_SQL))} AS "p_value",
  {sql_rounded('m1 - m2 - ' + _T_CRITICAL_SQL.format(df='df') + ' * sqrt(a + b)')} AS "lower",
  {sql_rounded('m1 - m2 + ' + _T_CRITICAL_SQL.format(df='df') + ' * sqrt(a + b)')} AS "upper" FROM u""")
def welch_t_(spark: SparkSession, sf: str) -> DataFrame:
    test = welch_t(plots(spark, sf), "Biomass", F.col("Exclosure") == "F")
    test = with_rounded(test, "mean_1", "mean_2", "t", "p_value", "lower", "upper")
    return with_rounded(test, "df", digits=4).select("mean_1", "mean_2", "t", "df", "p_value", "lower", "upper")


_LINE_SQL = """l AS (SELECT "BurnTreat" AS b, count(*) AS n, avg("Biomass") AS xm, regr_slope("Cover", "Biomass") AS k,
    regr_intercept("Cover", "Biomass") AS a, regr_r2("Cover", "Biomass") AS r2, regr_sxx("Cover", "Biomass") AS sxx,
    sqrt((regr_syy("Cover", "Biomass") - regr_slope("Cover", "Biomass") * regr_sxy("Cover", "Biomass")) / (count(*) - 2)) AS s,
    min("Biomass") AS lo, max("Biomass") AS hi
  FROM plots GROUP BY "BurnTreat")"""


@query(f"""WITH {PLOTS_SQL}, {_LINE_SQL}
SELECT b AS "BurnTreat", {sql_rounded('a', 4)} AS "intercept", {sql_rounded('k', 5)} AS "slope",
  {sql_rounded('s / sqrt(sxx)')} AS "slope_se", {sql_rounded('k / (s / sqrt(sxx))', 4)} AS "slope_t",
  {sql_rounded('s * sqrt(1.0 / n + xm * xm / sxx)', 5)} AS "intercept_se",
  {sql_rounded('r2', 8)} AS "r_squared", {sql_rounded('s', 4)} AS "sigma" FROM l""")
def ols_simple_(spark: SparkSession, sf: str) -> DataFrame:
    digits = {"intercept": 4, "slope": 5, "slope_se": 6, "slope_t": 4, "intercept_se": 5,
              "r_squared": 8, "sigma": 4}
    fit = ols(plots(spark, sf), "Cover", "Biomass", by=["BurnTreat"])
    return fit.select("BurnTreat", *[rounded(c, d).alias(c) for c, d in digits.items()])


@query(f"""WITH {PLOTS_SQL}, {_LINE_SQL},
g AS (SELECT *, lo + (hi - lo) * i / 79.0::DOUBLE AS x FROM l, (SELECT unnest(range(80)) AS i))
SELECT b AS "BurnTreat", {sql_rounded('x')} AS "x", {sql_rounded('a + k * x', 3)} AS "fit",
  {sql_rounded('e', 4)} AS "se", {sql_rounded('a + k * x - q * e', 3)} AS "lower", {sql_rounded('a + k * x + q * e', 3)} AS "upper"
FROM (SELECT *, s * sqrt(1.0 / n + (x - xm) * (x - xm) / sxx) AS e, {_T_CRITICAL_SQL.format(df='(n - 2)')} AS q FROM g)""")
def fit_band_(spark: SparkSession, sf: str) -> DataFrame:
    band = fit_band(plots(spark, sf), "Cover", "Biomass", n=80, by=["BurnTreat"])
    return band.select("BurnTreat", rounded("x").alias("x"), rounded("se", 4).alias("se"),
                       *[rounded(c, 3).alias(c) for c in ("fit", "lower", "upper")])


def _anova(table: DataFrame) -> DataFrame:
    """Comparable columns of an analysis-of-variance table."""
    return table.select("term", rounded("sum_sq", 4).alias("sum_sq"),
                        F.col("df").cast("double").alias("df"), rounded("f_value", 5).alias("f_value"))


def _anova_sql(rows: list[tuple[str, str, str]], rss: str, rdf: str, source: str) -> str:
    parts = [f"""SELECT '{term}' AS "term", {sql_rounded(ss, 4)} AS "sum_sq", CAST({df} AS DOUBLE) AS "df",
  {sql_rounded(f'({ss}) / ({df}) / (({rss}) / ({rdf}))', 5)} AS "f_value" FROM {source}"""
             for term, ss, df in rows]
    parts.append(f"""SELECT 'Residuals', {sql_rounded(rss, 4)}, CAST({rdf} AS DOUBLE), NULL FROM {source}""")
    return " UNION ALL ".join(parts)


@query(f"""WITH {PLOTS_SQL},
c AS (SELECT "BurnTreat", count(*) AS n, avg("Biomass") AS m, var_pop("Biomass") * count(*) AS ss FROM plots GROUP BY 1),
g AS (SELECT sum(n * m) / sum(n) AS gm FROM c),
t AS (SELECT sum(n * (m - gm) * (m - gm)) AS a, sum(ss) AS r, sum(n) - count(*) AS rdf, count(*) - 1 AS adf FROM c, g)
""" + _anova_sql([("BurnTreat", "a", "adf")], "r", "rdf", "t"))
def anova_oneway(spark: SparkSession, sf: str) -> DataFrame:
    return _anova(linear_model(plots(spark, sf), "Biomass", crossed("BurnTreat")).anova(1))


# Sums of squares of a burn x drought model on unbalanced rows. With two drought levels the
# additive model needs one slope, found from deviations within burn classes (and the other
# way round from a two-group comparison), so nested residuals have closed forms.
_TWO_FACTOR_SQL = f"""{PLOTS_SQL},
d AS (SELECT "BurnTreat" AS b, CASE "Drought" WHEN 'Drought' THEN 1.0::DOUBLE ELSE 0.0 END AS x, "Biomass" AS y FROM plots),
cell AS (SELECT b, x, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM d GROUP BY b, x),
burn AS (SELECT b, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss,
           covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM d GROUP BY b),
whole AS (SELECT avg(y) AS gm, var_pop(y) * count(*) AS total, covar_pop(x, y) * count(*) AS sxy,
            var_pop(x) * count(*) AS sxx, count(*) AS n FROM d),
t AS (SELECT w.n - 6 AS rdf,
    (SELECT sum(ss) FROM cell) AS r,
    w.total - (SELECT sum(ss) FROM burn) AS burn_alone,
    w.sxy * w.sxy / w.sxx AS drought_alone,
    (SELECT sum(sxy) * sum(sxy) / sum(sxx) FROM burn) AS drought_after,
    (SELECT sum(ss) - sum(sxy) * sum(sxy) / sum(sxx) FROM burn) AS additive_rss, w.total AS total
  FROM whole w)"""


@query(f"WITH {_TWO_FACTOR_SQL} " + _anova_sql(
    [("BurnTreat", "burn_alone", "2"), ("Drought", "drought_after", "1"),
     ("BurnTreat:Drought", "additive_rss - r", "2")], "r", "rdf", "t"))
def anova_type1(spark: SparkSession, sf: str) -> DataFrame:
    return _anova(linear_model(plots(spark, sf), "Biomass", crossed("BurnTreat", "Drought")).anova(1))


@query(f"WITH {_TWO_FACTOR_SQL} " + _anova_sql(
    [("BurnTreat", "total - drought_alone - additive_rss", "2"), ("Drought", "drought_after", "1"),
     ("BurnTreat:Drought", "additive_rss - r", "2")], "r", "rdf", "t"))
def anova_type2(spark: SparkSession, sf: str) -> DataFrame:
    return _anova(linear_model(plots(spark, sf), "Biomass", crossed("BurnTreat", "Drought")).anova(2))


def _contrast_anova_sql(contrasts: dict[str, str]) -> str:
    """One-df tests on the four cells of subplot x drought, from their means."""
    sums = ", ".join(f"sum(({c}) * m) * sum(({c}) * m) / sum(({c}) * ({c}) / n) AS s{i}"
                     for i, c in enumerate(contrasts.values()))
    return f"""WITH {PLOTS_SQL},
c AS (SELECT CASE "Exclosure" WHEN 'O' THEN 1 ELSE 0 END AS e, CASE "Drought" WHEN 'Drought' THEN 1 ELSE 0 END AS d,
        count(*)::DOUBLE AS n, avg("Biomass") AS m, var_pop("Biomass") * count(*) AS ss FROM plots GROUP BY 1, 2),
t AS (SELECT {sums}, sum(ss) AS r, sum(n) - 4 AS rdf FROM c)
""" + _anova_sql([(term, f"s{i}", "1") for i, term in enumerate(contrasts)], "r", "rdf", "t")


@query(_contrast_anova_sql({
    "(Intercept)": "(1 - e) * (1 - d)", "Exclosure": "(2 * e - 1) * (1 - d)",
    "Drought": "(1 - e) * (2 * d - 1)", "Exclosure:Drought": "(2 * e - 1) * (2 * d - 1)"}))
def anova_type3(spark: SparkSession, sf: str) -> DataFrame:
    """Treatment coding: simple effects at the baseline levels."""
    return _anova(linear_model(plots(spark, sf), "Biomass", crossed("Exclosure", "Drought")).anova(3))


@query(_contrast_anova_sql({
    "(Intercept)": "1", "Exclosure": "2 * e - 1", "Drought": "2 * d - 1",
    "Exclosure:Drought": "(2 * e - 1) * (2 * d - 1)"}))
def anova_type3_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Sum coding: effects averaged over the other factor."""
    return _anova(linear_model(plots(spark, sf), "Biomass", crossed("Exclosure", "Drought"),
                               contrasts="sum").anova(3))


@query(f"""WITH {PLOTS_SQL},
b AS (SELECT var_pop("Biomass") * count(*) AS yy, var_pop("Severity") * count(*) AS xx,
        covar_pop("Severity", "Biomass") * count(*) AS xy FROM plots GROUP BY "BurnTreat"),
w AS (SELECT sum(xy) * sum(xy) / sum(xx) AS s, sum(yy) - sum(xy) * sum(xy) / sum(xx) AS r FROM b),
a AS (SELECT var_pop("Biomass") * count(*) - pow(covar_pop("Severity", "Biomass") * count(*), 2)
        / (var_pop("Severity") * count(*)) AS alone, count(*) - 4 AS rdf FROM plots),
t AS (SELECT * FROM w, a)
""" + _anova_sql([("Severity", "s", "1"), ("BurnTreat", "alone - r", "2")], "r", "rdf", "t"))
def ancova_type2(spark: SparkSession, sf: str) -> DataFrame:
    model = linear_model(plots(spark, sf), "Biomass", terms("Severity", "BurnTreat"),
                         covariates=["Severity"])
    return _anova(model.anova(2))


def _slope_anova_sql() -> str:
    """Subplot x drought x numeric water year: each cell has its own line."""
    cells = {"": "(1 - e) * (1 - d)", "Exclosure": "(2 * e - 1) * (1 - d)",
             "Drought": "(1 - e) * (2 * d - 1)", "Exclosure:Drought": "(2 * e - 1) * (2 * d - 1)"}
    sums, rows = [], []
    for i, (name, c) in enumerate(cells.items()):
        for kind, value, weight in (("i", "a", "(1 / n + xm * xm / sxx)"), ("s", "k", "(1 / sxx)")):
            sums.append(f"sum(({c}) * {value}) * sum(({c}) * {value}) / sum(({c}) * ({c}) * {weight}) AS {kind}{i}")
        rows.append((name or "(Intercept)", f"i{i}", "1"))
        rows.append((f"{name}:Water_Year" if name else "Water_Year", f"s{i}", "1"))
    return f"""WITH {PLOTS_SQL},
v AS (SELECT *, year(l_shipdate) + CASE WHEN month(l_shipdate) >= 10 THEN 1 ELSE 0 END AS wy FROM plots),
c AS (SELECT CASE "Exclosure" WHEN 'O' THEN 1 ELSE 0 END AS e, CASE "Drought" WHEN 'Drought' THEN 1 ELSE 0 END AS d,
        count(*)::DOUBLE AS n, avg(wy) AS xm, var_pop(wy) * count(*) AS sxx,
        covar_pop(wy, "Biomass") / var_pop(wy) AS k, avg("Biomass") - covar_pop(wy, "Biomass") / var_pop(wy) * avg(wy) AS a,
        (var_pop("Biomass") - pow(covar_pop(wy, "Biomass"), 2) / var_pop(wy)) * count(*) AS ss FROM v GROUP BY 1, 2),
t AS (SELECT {', '.join(sums)}, sum(ss) AS r, sum(n) - 8 AS rdf FROM c)
""" + _anova_sql(rows, "r", "rdf", "t")


@query(_slope_anova_sql())
def moisture_anova(spark: SparkSession, sf: str) -> DataFrame:
    df = plots(spark, sf).withColumn("Water_Year", water_year("l_shipdate"))
    model = linear_model(df, "Biomass", crossed("Exclosure", "Drought", "Water_Year"),
                         covariates=["Water_Year"])
    return _anova(model.anova(3))


_CELLS_SQL = f"""{PLOTS_SQL},
c AS (SELECT "BurnTreat" AS b, "Drought" AS d, count(*)::DOUBLE AS n, avg("Biomass") AS m, var_pop("Biomass") * count(*) AS ss
      FROM plots GROUP BY 1, 2),
s AS (SELECT sum(ss) / (sum(n) - count(*)) AS s2 FROM c)"""


@query(f"""WITH {_CELLS_SQL},
k(term, b, d, w) AS (VALUES ('(Intercept)', 'Moderate_Burn', 'Ambient', 1),
  ('BurnTreatSevere_Burn', 'Severe_Burn', 'Ambient', 1), ('BurnTreatSevere_Burn', 'Moderate_Burn', 'Ambient', -1),
  ('BurnTreatUnburned', 'Unburned', 'Ambient', 1), ('BurnTreatUnburned', 'Moderate_Burn', 'Ambient', -1),
  ('DroughtDrought', 'Moderate_Burn', 'Drought', 1), ('DroughtDrought', 'Moderate_Burn', 'Ambient', -1),
  ('BurnTreatSevere_Burn:DroughtDrought', 'Severe_Burn', 'Drought', 1), ('BurnTreatSevere_Burn:DroughtDrought', 'Severe_Burn', 'Ambient', -1),
  ('BurnTreatSevere_Burn:DroughtDrought', 'Moderate_Burn', 'Drought', -1), ('BurnTreatSevere_Burn:DroughtDrought', 'Moderate_Burn', 'Ambient', 1),
  ('BurnTreatUnburned:DroughtDrought', 'Unburned', 'Drought', 1), ('BurnTreatUnburned:DroughtDrought', 'Unburned', 'Ambient', -1),
  ('BurnTreatUnburned:DroughtDrought', 'Moderate_Burn', 'Drought', -1), ('BurnTreatUnburned:DroughtDrought', 'Moderate_Burn', 'Ambient', 1))
SELECT k.term AS "term", {sql_rounded('sum(w * m)')} AS "estimate", {sql_rounded('sqrt(any_value(s2) * sum(w * w / n))')} AS "std_error"
FROM k JOIN c ON k.b = c.b AND k.d = c.d, s GROUP BY k.term""")
def linear_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    fit = linear_model(plots(spark, sf), "Biomass", crossed("BurnTreat", "Drought"))
    return with_rounded(fit.coefficients(), "estimate", "std_error").select(
        "term", "estimate", "std_error")


@query(f"""WITH {_CELLS_SQL},
t AS (SELECT sum(n) AS n, sum(ss) AS r, sum(n) - 6 AS rdf FROM c),
a AS (SELECT var_pop("Biomass") * count(*) AS total FROM plots)
SELECT CAST(n AS BIGINT) AS "n", CAST(rdf AS BIGINT) AS "df_resid", {sql_rounded('sqrt(r / rdf)')} AS "sigma",
  {sql_rounded('1 - r / total', 8)} AS "r_squared", {sql_rounded('(total - r) / 5 / (r / rdf)', 5)} AS "f_value" FROM t, a""")
def linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    stats = linear_model(plots(spark, sf), "Biomass", crossed("BurnTreat", "Drought")).fit_stats()
    return stats.select("n", "df_resid", rounded("sigma").alias("sigma"),
                        rounded("r_squared", 8).alias("r_squared"),
                        rounded("f_value", 5).alias("f_value"))


@query(f"""WITH {_CELLS_SQL}
SELECT b AS "BurnTreat", {sql_rounded('avg(m)')} AS "emmean", {sql_rounded('sqrt(any_value(s2) * sum(1 / n)) / count(*)')} AS "se"
FROM c, s GROUP BY b""")
def emmeans_(spark: SparkSession, sf: str) -> DataFrame:
    fit = linear_model(plots(spark, sf), "Biomass", crossed("BurnTreat", "Drought"))
    return with_rounded(fit.emmeans(["BurnTreat"]), "emmean", "se").select(
        "BurnTreat", "emmean", "se")


@query(f"""WITH {_CELLS_SQL},
e AS (SELECT b, avg(m) AS m, any_value(s2) * sum(1 / n) / 4 AS v FROM c, s GROUP BY b)
SELECT x.b || ' - ' || y.b AS "contrast", {sql_rounded('x.m - y.m')} AS "estimate", {sql_rounded('sqrt(x.v + y.v)')} AS "se",
  {sql_rounded('(x.m - y.m) / sqrt(x.v + y.v)', 5)} AS "t_ratio" FROM e x JOIN e y ON x.b < y.b""")
def pairwise_(spark: SparkSession, sf: str) -> DataFrame:
    fit = linear_model(plots(spark, sf), "Biomass", crossed("BurnTreat", "Drought"))
    pairs = with_rounded(fit.pairwise(["BurnTreat"]), "estimate", "se")
    return with_rounded(pairs, "t_ratio", digits=5).select("contrast", "estimate", "se", "t_ratio")


@query(f"""WITH {_CELLS_SQL},
g AS (SELECT 'BurnTreat' AS term, b AS l, sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY b
      UNION ALL SELECT 'Drought', d, sum(n), sum(n * m) / sum(n) FROM c GROUP BY d)
SELECT x.term AS "term", y.l || '-' || x.l AS "comparison", {sql_rounded('y.m - x.m')} AS "diff",
  {sql_rounded('sqrt(s2 / 2 * (1 / x.n + 1 / y.n))')} AS "se"
FROM g x JOIN g y ON x.term = y.term AND x.l < y.l, s""")
def tukey_hsd_(spark: SparkSession, sf: str) -> DataFrame:
    fit = linear_model(plots(spark, sf), "Biomass", crossed("BurnTreat", "Drought"))
    return with_rounded(fit.tukey_hsd(["BurnTreat", "Drought"]), "diff", "se").select(
        "term", "comparison", "diff", "se")


_POISSON_SQL = f"""{PLOTS_SQL},
v AS (SELECT "BurnTreat" AS b, "Drought" AS d, "Biomass" AS y, avg("Biomass") OVER (PARTITION BY "BurnTreat", "Drought") AS mu FROM plots),
f AS (SELECT count(*) AS n, count(*) - 6 AS rdf, 2 * sum(CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu)) AS deviance,
        sum((y - mu) * (y - mu) / mu) / (count(*) - 6) AS phi FROM v)"""


@query(f"""WITH {_POISSON_SQL}
SELECT CAST(n AS BIGINT) AS "n", CAST(rdf AS BIGINT) AS "df_resid", {sql_rounded('deviance', 3)} AS "deviance",
  {sql_rounded('phi')} AS "dispersion" FROM f""")
def glm_quasipoisson_(spark: SparkSession, sf: str) -> DataFrame:
    stats = glm_quasipoisson(plots(spark, sf), "Biomass", crossed("BurnTreat", "Drought")).fit_stats()
    return with_rounded(with_rounded(stats, "dispersion"), "deviance", digits=3)


@query(f"""WITH {_POISSON_SQL},
c AS (SELECT b, d, count(*)::DOUBLE AS n, any_value(mu) AS mu FROM v GROUP BY b, d)
SELECT b AS "BurnTreat", {sql_rounded('avg(ln(mu))')} AS "emmean",
  {sql_rounded('sqrt(any_value(phi) * sum(1 / (c.n * mu))) / count(*)', 8)} AS "se" FROM c, f GROUP BY b""")
def glm_quasipoisson_emmeans_(spark: SparkSession, sf: str) -> DataFrame:
    fit = glm_quasipoisson(plots(spark, sf), "Biomass", crossed("BurnTreat", "Drought"))
    means = with_rounded(fit.emmeans(["BurnTreat"]), "emmean")
    return with_rounded(means, "se", digits=8).select("BurnTreat", "emmean", "se")


@query(f"""WITH {PLOTS_SQL},
v AS (SELECT "Biomass" AS y, avg("Biomass") OVER (PARTITION BY "BurnTreat") AS mu, avg("Biomass") OVER () AS m0 FROM plots),
f AS (SELECT 2 * sum(y * ln(mu / m0)) AS lr, sum((y - mu) * (y - mu) / mu) / (count(*) - 3) AS phi FROM v)
SELECT 'BurnTreat' AS "term", {sql_rounded('lr / phi', 4)} AS "lr_chisq", CAST(2 AS BIGINT) AS "df",
  {sql_rounded('exp(-lr / phi / 2)', 5)} AS "p_value" FROM f""")
def glm_quasipoisson_anova_(spark: SparkSession, sf: str) -> DataFrame:
    fit = glm_quasipoisson(plots(spark, sf), "Biomass", crossed("BurnTreat"))
    table = with_rounded(with_rounded(fit.anova(3), "lr_chisq", digits=4), "p_value", digits=5)
    return table.select("term", "lr_chisq", "df", "p_value")


@query(f"""WITH {PLOTS_SQL},
c AS (SELECT "BurnTreat" AS b, count(*)::DOUBLE AS n, avg("Biomass") AS m, var_samp("Biomass") AS v FROM plots GROUP BY 1),
t AS (SELECT sum(n) - 3 AS rdf, sum((n - 1) * v) / (sum(n) - 3) AS s2, sum(n * m) / sum(n) AS gm FROM c),
f AS (SELECT sum(n * (m - gm) * (m - gm)) / 2 / any_value(s2) AS f, any_value(rdf) AS rdf FROM c, t)
SELECT 'BurnTreat' AS "term", CAST(2 AS BIGINT) AS "df", {sql_rounded('f', 5)} AS "f_value",
  {sql_rounded('pow(1 + 2 * f / rdf, -rdf / 2)')} AS "p_value" FROM f""")
def anova_p_value(spark: SparkSession, sf: str) -> DataFrame:
    """With two numerator degrees of freedom the tail of F has a closed form."""
    table = linear_model(plots(spark, sf), "Biomass", crossed("BurnTreat")).anova(3).where("term = 'BurnTreat'")
    return with_rounded(with_rounded(table, "f_value", digits=5), "p_value").select("term", "df", "f_value", "p_value")


@query()
def glm_quasipoisson_factorial_(spark: SparkSession, sf: str) -> DataFrame:
    """Refits without an interaction have no closed form."""
    fit = glm_quasipoisson(plots(spark, sf), "Biomass", crossed("Year", "Drought", "BurnTreat"))
    return with_rounded(fit.anova(3), "lr_chisq", digits=3).select("term", "lr_chisq", "df")


EQUATIONS = {"Biomass": ["Severity"], "Cover": ["Biomass", "Severity"],
             "l_tax": ["Biomass", "Severity"]}
EFFECTS = {
    "indirect_cover": [[("Cover", "Biomass"), ("Biomass", "Severity")]],
    "total_cover": [[("Cover", "Severity")], [("Cover", "Biomass"), ("Biomass", "Severity")]],
}

# Maximum likelihood is equation-wise least squares with residual variance over n.
_PATH_SQL = f"""{PLOTS_SQL},
m AS (SELECT count(*)::DOUBLE AS n, var_pop("Severity") AS sx, var_pop("Biomass") AS sb, covar_pop("Severity", "Biomass") AS sxb,
        var_pop("Cover") AS sc, covar_pop("Severity", "Cover") AS sxc, covar_pop("Biomass", "Cover") AS sbc,
        var_pop(l_tax) AS st, covar_pop("Severity", l_tax) AS sxt, covar_pop("Biomass", l_tax) AS sbt FROM plots),
p AS (SELECT *, sxb / sx AS a, sb * sx - sxb * sxb AS det,
        (sx * sbc - sxb * sxc) / (sb * sx - sxb * sxb) AS cb, (sb * sxc - sxb * sbc) / (sb * sx - sxb * sxb) AS cx,
        (sx * sbt - sxb * sxt) / (sb * sx - sxb * sxb) AS tb, (sb * sxt - sxb * sbt) / (sb * sx - sxb * sxb) AS tx FROM m),
q AS (SELECT *, sqrt((sb - a * sxb) / (n * sx)) AS ea,
        sqrt((sc - cb * sbc - cx * sxc) / n * sx / det) AS ecb, sqrt((sc - cb * sbc - cx * sxc) / n * sb / det) AS ecx,
        sqrt((st - tb * sbt - tx * sxt) / n * sx / det) AS etb, sqrt((st - tb * sbt - tx * sxt) / n * sb / det) AS etx,
        -(sc - cb * sbc - cx * sxc) / n * sxb / det AS ccov FROM p)"""


@query(f"""WITH {_PATH_SQL}
""" + " UNION ALL ".join(
    f"""SELECT '{y}' AS "lhs", '{x}' AS "rhs", {sql_rounded(b, 7)} AS "estimate", {sql_rounded(e, 7)} AS "se",
  {sql_rounded(f'{b} / {e}', 5)} AS "z", {sql_rounded(f'{b} * sqrt({vx} / {vy})')} AS "standardised" FROM q"""
    for y, x, b, e, vy, vx in [("Biomass", "Severity", "a", "ea", "sb", "sx"), ("Cover", "Biomass", "cb", "ecb", "sc", "sb"),
                               ("Cover", "Severity", "cx", "ecx", "sc", "sx"), ("l_tax", "Biomass", "tb", "etb", "st", "sb"),
                               ("l_tax", "Severity", "tx", "etx", "st", "sx")]))
def path_model_(spark: SparkSession, sf: str) -> DataFrame:
    fit = path_model(plots(spark, sf), EQUATIONS).coefficients().where("op = '~'")
    fit = with_rounded(with_rounded(with_rounded(fit, "estimate", "se", digits=7), "z", digits=5), "standardised")
    return fit.select("lhs", "rhs", "estimate", "se", "z", "standardised")


@query(f"""WITH {_PATH_SQL}
SELECT 'indirect_cover' AS "effect", {sql_rounded('a * cb', 5)} AS "estimate",
  {sql_rounded('sqrt(cb * cb * ea * ea + a * a * ecb * ecb)', 5)} AS "se" FROM q
UNION ALL SELECT 'total_cover', {sql_rounded('cx + a * cb', 5)},
  {sql_rounded('sqrt(cb * cb * ea * ea + a * a * ecb * ecb + ecx * ecx + 2 * a * ccov)', 5)} FROM q""")
def path_effects(spark: SparkSession, sf: str) -> DataFrame:
    fit = path_model(plots(spark, sf), EQUATIONS).effects(EFFECTS)
    return with_rounded(fit, "estimate", "se", digits=5).select("effect", "estimate", "se")


# With a fixed predictor variance v the implied moments differ from the sample's by the variance excess d alone, times the total
# effects k of the predictor on both variables: one for itself, a, cx + a cb and tx + a tb for the outcomes.
_FIT_SQL = f"""{_PATH_SQL},
r AS (SELECT q.*, sx - 0.001 AS d, sx / 0.001 AS ratio, sb - a * sxb AS vb, sc - cb * sbc - cx * sxc AS vc, st - tb * sbt - tx * sxt AS vt,
        (SELECT covar_pop("Cover", l_tax) FROM plots) - cb * sbt - cx * sxt AS vct,
        1 / sx AS u1, a * a / sb AS u2, pow(cx + a * cb, 2) / sc AS u3, pow(tx + a * tb, 2) / st AS u4 FROM q),
f AS (SELECT *, n * (ratio - ln(ratio) - 1) AS chisq, ln(sx * vb) + ln(vc * vt - vct * vct) AS logdet FROM r),
g AS (SELECT *, n * (ln(sx) + ln(sb) + ln(sc) + ln(st) - logdet) AS base, -n / 2 * (4 * ln(2 * pi()) + logdet - ln(ratio) + 3 + ratio) AS ll FROM f)"""


@query(f"""WITH {_FIT_SQL}
SELECT CAST(n AS BIGINT) AS "n", CAST(13 AS BIGINT) AS "n_parameters", {sql_rounded('chisq', 4)} AS "chisq", CAST(1 AS BIGINT) AS "df",
  {sql_rounded('1 - ' + _central_sql('sqrt(chisq)', 'exp(-x * x / 2) / sqrt(2 * pi())'), 5)} AS "p_value",
  {sql_rounded('1 - greatest(chisq - 1, 0) / greatest(base - 6, chisq - 1, 0)')} AS "cfi",
  {sql_rounded('(base / 6 - chisq) / (base / 6 - 1)')} AS "tli", {sql_rounded('sqrt(greatest(chisq - 1, 0) / n)')} AS "rmsea",
  {sql_rounded('abs(d) * sqrt((pow(u1 + u2 + u3 + u4, 2) + u1 * u1 + u2 * u2 + u3 * u3 + u4 * u4) / 2 / 14)')} AS "srmr",
  {sql_rounded('ll', 2)} AS "loglik", {sql_rounded('26 - 2 * ll', 2)} AS "aic", {sql_rounded('13 * ln(n) - 2 * ll', 2)} AS "bic" FROM g""")
def path_fit(spark: SparkSession, sf: str) -> DataFrame:
    """With a fixed predictor variance the only misfit is that variance."""
    fit = path_model(plots(spark, sf), EQUATIONS, fixed_var={"Severity": 0.001}).fit()
    fit = with_rounded(with_rounded(with_rounded(fit, "chisq", digits=4), "p_value", digits=5), "loglik", "aic", "bic", digits=2)
    return with_rounded(fit, "cfi", "tli", "rmsea", "srmr")


# One mean per plot and subplot: every plot has both, so REML has its balanced closed form.
_BALANCED_SQL = f"""{PLOTS_SQL},
y AS (SELECT "Plot" AS g, "Exclosure" AS e, avg("Biomass") + any_value("Plot") / 3.0::DOUBLE AS y FROM plots GROUP BY "Plot", "Exclosure"),
d AS (SELECT g, max(CASE e WHEN 'F' THEN y END) - max(CASE e WHEN 'O' THEN y END) AS diff, avg(y) AS m FROM y GROUP BY g),
v AS (SELECT count(*) AS k, var_samp(diff) / 2 AS mse, 2 * var_samp(m) AS msg, avg(m) AS gm, avg(diff) AS gd FROM d)"""


def _balanced(spark: SparkSession, sf: str) -> DataFrame:
    means = plots(spark, sf).groupBy("Plot", "Exclosure").agg(F.avg("Biomass").alias("m"))
    return means.select("Plot", "Exclosure", (F.col("m") + F.col("Plot") / F.lit(3.0)).alias("y"))


@query(f"""WITH {_BALANCED_SQL}
SELECT CAST(2 * k AS BIGINT) AS "n", CAST(k AS BIGINT) AS "n_groups", {sql_rounded('(msg - mse) / 2', 5)} AS "group_variance",
  {sql_rounded('mse', 5)} AS "residual_variance" FROM v""")
def lmm_(spark: SparkSession, sf: str) -> DataFrame:
    fit = lmm(_balanced(spark, sf), "y", crossed("Exclosure"), "Plot", contrasts="sum")
    return with_rounded(fit.variances(), "group_variance", "residual_variance", digits=5).select(
        "n", "n_groups", "group_variance", "residual_variance")


@query(f"""WITH {_BALANCED_SQL}
SELECT '(Intercept)' AS "term", {sql_rounded('gm')} AS "estimate", {sql_rounded('sqrt(msg / (2 * k))', 5)} AS "std_error",
  {sql_rounded('k - 1', 1)} AS "df" FROM v
UNION ALL SELECT 'Exclosure1', {sql_rounded('gd / 2')}, {sql_rounded('sqrt(mse / (2 * k))', 5)}, {sql_rounded('k - 1', 1)} FROM v""")
def satterthwaite_(spark: SparkSession, sf: str) -> DataFrame:
    fit = lmm(_balanced(spark, sf), "y", crossed("Exclosure"), "Plot", contrasts="sum")
    rows = with_rounded(with_rounded(fit.coefficients(), "estimate"), "std_error", digits=5)
    return with_rounded(rows, "df", digits=1).select("term", "estimate", "std_error", "df")


# Plots lie within burn treatments: plot means and subplot differences are two one-way layouts.
_SPLIT_SQL = f"""{_BALANCED_SQL},
b AS (SELECT {BURN_SQL.format('g')} AS b, count(*)::DOUBLE AS n, avg(diff) AS ad, var_samp(diff) AS vd, avg(m) AS am, var_samp(m) AS vm
  FROM d GROUP BY 1),
w AS (SELECT sum((n - 1) * vd) / (sum(n) - 3) AS wd, sum((n - 1) * vm) / (sum(n) - 3) AS wm, sum(n * ad) / sum(n) AS gd,
    sum(n * am) / sum(n) AS gm, avg(ad) AS ud, avg(am) AS um, sum(1 / n) / 9 AS h FROM b),
x AS (SELECT sum(n * (am - gm) * (am - gm)) / any_value(wm) AS xb, sum(n * (ad - gd) * (ad - gd)) / any_value(wd) AS xi FROM b, w)"""


def _split_plot(spark: SparkSession, sf: str):
    return lmm(with_treatments(_balanced(spark, sf)), "y", crossed("BurnTreat", "Exclosure"), "Plot", contrasts="sum")


@query(f"""WITH {_SPLIT_SQL}
SELECT '(Intercept)' AS "term", {sql_rounded('um * um / (wm * h)', 3)} AS "chisq", CAST(1 AS BIGINT) AS "df", CAST(NULL AS DOUBLE) AS "p_value" FROM w
UNION ALL SELECT 'BurnTreat', {sql_rounded('xb', 3)}, CAST(2 AS BIGINT), {sql_rounded('exp(-xb / 2)', 5)} FROM x
UNION ALL SELECT 'Exclosure', {sql_rounded('ud * ud / (wd * h)', 3)}, CAST(1 AS BIGINT), CAST(NULL AS DOUBLE) FROM w
UNION ALL SELECT 'BurnTreat:Exclosure', {sql_rounded('xi', 3)}, CAST(2 AS BIGINT), {sql_rounded('exp(-xi / 2)', 5)} FROM x""")
def lmm_wald_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """Wald tests of a split-plot model; the tail of two degrees of freedom is an exponential."""
    table = with_rounded(with_rounded(_split_plot(spark, sf).anova(3), "chisq", digits=3), "p_value", digits=5)
    return table.select("term", "chisq", "df", F.when(F.col("df") == 2, F.col("p_value")).alias("p_value"))


@query(f"""WITH {_SPLIT_SQL}
SELECT p.b || ' - ' || q.b AS "contrast", {sql_rounded('p.am - q.am', 5)} AS "estimate", {sql_rounded('sqrt(wm * (1 / p.n + 1 / q.n))', 5)} AS "se"
FROM b p JOIN b q ON p.b < q.b, w""")
def lmm_contrasts_balanced(spark: SparkSession, sf: str) -> DataFrame:
    fit = _split_plot(spark, sf)
    return with_rounded(fit.pairwise(["BurnTreat"]), "estimate", "se", digits=5).select("contrast", "estimate", "se")


@query()
def lmm_wald_(spark: SparkSession, sf: str) -> DataFrame:
    """Unbalanced rows, one intercept per supplier."""
    fit = lmm(plots(spark, sf), "Biomass", crossed("BurnTreat", "Exclosure", "Drought"),
              "l_suppkey", contrasts="sum")
    return with_rounded(fit.anova(3), "chisq", digits=3).select("term", "chisq", "df")


@query()
def lmm_contrasts_(spark: SparkSession, sf: str) -> DataFrame:
    fit = lmm(plots(spark, sf), "Biomass", crossed("BurnTreat", "Exclosure"), "l_suppkey",
              contrasts="sum")
    return with_rounded(fit.pairwise(["BurnTreat", "Exclosure"]), "estimate", "se", digits=4).select(
        "contrast", "estimate", "se")


def _survival(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).where(F.col("Status").isNotNull())
    return with_treatments(df.withColumn("Survival", (F.col("Status") == "alive").cast("int")))


@query()
def glmm_binomial_(spark: SparkSession, sf: str) -> DataFrame:
    fit = glmm_binomial(_survival(spark, sf), "Survival", crossed("BurnTreat", "Drought"), "Tag")
    return with_rounded(fit.coefficients(), "estimate", "std_error", digits=3).select(
        "term", "estimate", "std_error")


@query()
def glmm_binomial_wald_(spark: SparkSession, sf: str) -> DataFrame:
    fit = glmm_binomial(_survival(spark, sf), "Survival", terms(crossed("BurnTreat", "Drought"), "Year"),
                        "Tag", covariates=["Year"], contrasts="sum")
    return with_rounded(fit.anova(3), "chisq", digits=2).select("term", "chisq", "df")
