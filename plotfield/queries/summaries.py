"""Queries for grouped summaries, box statistics, seasons and group-level filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotfield.functions import as_date, season, water_year
from plotfield.operators import (
    box_outliers, box_stats, contingency, distinct_rows, duplicate_keys, earliest_rows,
    entity_mean, exact_quantiles, first_seen, keep_groups_any, mean_sd_table, mean_se,
    null_count, pool_se, proportion_se, rates, summarise_across, var_table, zscore,
)
from plotfield.queries.registry import query, sql_rounded, with_rounded
from plotfield.queries.tables import (
    INDIVIDUALS_SQL, PLOTS_SQL, SENSORS_SQL, individuals, load, plots, sensors,
)

SEASONS = [("1996-04-01", "1997-05-01", "1996-1997"), ("1997-05-01", "1998-04-30", "1997-1998")]


@query(f"""WITH {PLOTS_SQL}
SELECT "BurnTreat", "Exclosure", {sql_rounded('avg("Biomass")')} AS "mean",
  {sql_rounded('stddev_samp("Biomass")')} AS "sd",
  {sql_rounded('stddev_samp("Biomass") / sqrt(count(*))')} AS "se", CAST(count(*) AS BIGINT) AS "n"
FROM plots GROUP BY ALL""")
def treatment_mean_se(spark: SparkSession, sf: str) -> DataFrame:
    stats = mean_se(plots(spark, sf), ["BurnTreat", "Exclosure"], "Biomass")
    return with_rounded(stats, "mean", "sd", "se")


@query(f"""WITH {PLOTS_SQL}
SELECT "Year", "BurnTreat", "Drought", "Depth", {sql_rounded('avg("Litter")', 8)} AS "mean",
  {sql_rounded('stddev_samp("Litter") / sqrt(count("Litter"))', 8)} AS "se",
  CAST(count(*) AS BIGINT) AS "n"
FROM plots GROUP BY ALL""")
def mean_se_nonnull(spark: SparkSession, sf: str) -> DataFrame:
    stats = mean_se(plots(spark, sf), ["Year", "BurnTreat", "Drought", "Depth"], "Litter",
                    n="nonnull")
    return with_rounded(stats.drop("sd"), "mean", "se", digits=8)


@query(f"""WITH {PLOTS_SQL}
SELECT "Plot", "Year", "Depth", "Exclosure",
  {sql_rounded('CASE WHEN count("Litter") = count(*) THEN avg("Litter") END', 8)} AS "mean",
  {sql_rounded('CASE WHEN count("Litter") = count(*) THEN stddev_samp("Litter") / sqrt(count(*)) END', 8)} AS "se"
FROM plots GROUP BY ALL""")
def mean_se_strict(spark: SparkSession, sf: str) -> DataFrame:
    stats = mean_se(plots(spark, sf), ["Plot", "Year", "Depth", "Exclosure"], "Litter",
                    strict=True)
    return with_rounded(stats.drop("sd", "n"), "mean", "se", digits=8)


@query(f"""WITH {PLOTS_SQL},
s AS (SELECT "BurnTreat", "Drought", "Year", avg("Biomass") AS m,
        stddev_samp("Biomass") / sqrt(count(*)) AS e FROM plots GROUP BY ALL)
SELECT "Year", "BurnTreat", {sql_rounded('avg(m)')} AS "mean",
  {sql_rounded('sqrt(sum(e * e)) / count(*)')} AS "se" FROM s GROUP BY ALL""")
def pooled_se(spark: SparkSession, sf: str) -> DataFrame:
    stats = mean_se(plots(spark, sf), ["BurnTreat", "Drought", "Year"], "Biomass")
    return with_rounded(pool_se(stats, ["Year", "BurnTreat"], "mean", "se"), "mean", "se")


ACROSS = ["Biomass", "Cover", "Litter", "Severity", "l_tax"]


@query(f"""WITH {PLOTS_SQL}
SELECT "BurnTreat", """ + ", ".join(
    f"""{sql_rounded(f'avg("{c}")', 5)} AS "{c}_mean", {sql_rounded(f'stddev_samp("{c}")', 5)} AS "{c}_sd" """
    for c in ACROSS) + """ FROM plots GROUP BY "BurnTreat" """)
def across_summary(spark: SparkSession, sf: str) -> DataFrame:
    stats = summarise_across(plots(spark, sf), ["BurnTreat"], ACROSS)
    return with_rounded(stats, *[c for c in stats.columns if c != "BurnTreat"], digits=5)


@query(f"""WITH {PLOTS_SQL}
""" + " UNION ALL ".join(
    f"""SELECT "BurnTreat", '{c}' AS "variable",
  printf('%.2f', avg("{c}")) || ' ± ' || printf('%.2f', stddev_samp("{c}")) AS "mean_sd"
FROM plots GROUP BY "BurnTreat" """ for c in ("Biomass", "Cover", "Litter")))
def mean_sd_table_(spark: SparkSession, sf: str) -> DataFrame:
    return mean_sd_table(plots(spark, sf), ["BurnTreat"], ["Biomass", "Cover", "Litter"])


@query(f"""WITH {PLOTS_SQL}
""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "variable", CAST(count("{c}") AS DOUBLE) AS "nobs",
  CAST(count(*) - count("{c}") AS DOUBLE) AS "missing", {sql_rounded(f'avg("{c}")', 4)} AS "mean",
  {sql_rounded(f'var_samp("{c}")', 2)} AS "variance" FROM plots""" for c in ACROSS))
def var_table_(spark: SparkSession, sf: str) -> DataFrame:
    stats = var_table(plots(spark, sf), ACROSS)
    return with_rounded(with_rounded(stats, "mean", digits=4), "variance", digits=2)


_BOX_SQL = f"""WITH {SENSORS_SQL},
q AS (SELECT "BurnTreat", "Drought", quantile_cont("VWC", 0.25) AS q1, quantile_cont("VWC", 0.5) AS md,
        quantile_cont("VWC", 0.75) AS q3 FROM sensors GROUP BY ALL),
f AS (SELECT s."BurnTreat", s."Drought", q1, md, q3, "VWC" AS v,
        "VWC" BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM sensors s JOIN q ON s."BurnTreat" = q."BurnTreat" AND s."Drought" = q."Drought")"""


@query(_BOX_SQL + f"""
SELECT "BurnTreat", "Drought", {sql_rounded('least(min(v) FILTER (inside), q1)')} AS "lower",
  {sql_rounded('q1')} AS "q1", {sql_rounded('md')} AS "median", {sql_rounded('q3')} AS "q3",
  {sql_rounded('greatest(max(v) FILTER (inside), q3)')} AS "upper", CAST(count(*) AS BIGINT) AS "n",
  CAST(count(*) FILTER (NOT inside) AS BIGINT) AS "n_outliers"
FROM f GROUP BY "BurnTreat", "Drought", q1, md, q3""")
def box_stats_(spark: SparkSession, sf: str) -> DataFrame:
    stats = box_stats(sensors(spark, sf), ["BurnTreat", "Drought"], "VWC")
    return with_rounded(stats, "lower", "q1", "median", "q3", "upper")


@query(_BOX_SQL + """ SELECT "BurnTreat", "Drought", v AS "VWC" FROM f WHERE NOT inside""")
def box_outliers_(spark: SparkSession, sf: str) -> DataFrame:
    return box_outliers(sensors(spark, sf), ["BurnTreat", "Drought"], "VWC")


@query(f"""WITH {PLOTS_SQL}
SELECT "BurnTreat", CAST(count(*) AS BIGINT) AS "n", """ + ", ".join(
    f"""{sql_rounded(f'quantile_cont("Cover", {p})', 4)} AS "q{i}" """
    for i, p in enumerate((0.05, 0.25, 0.5, 0.75, 0.95))) + """FROM plots GROUP BY "BurnTreat" """)
def exact_quantiles_(spark: SparkSession, sf: str) -> DataFrame:
    stats = exact_quantiles(plots(spark, sf), ["BurnTreat"], "Cover", [0.05, 0.25, 0.5, 0.75, 0.95])
    return with_rounded(stats, *[f"q{i}" for i in range(5)], digits=4)


@query(f"""WITH {INDIVIDUALS_SQL}, a AS (SELECT * FROM
  (SELECT DISTINCT "Species" FROM individuals WHERE "Species" IS NOT NULL),
  (SELECT DISTINCT "Type" FROM individuals WHERE "Type" IS NOT NULL),
  (VALUES ('alive'), ('dead'), ('unknown')) s("Status"))
SELECT a."Species", a."Type", a."Status", CAST(count(i."Plot") AS BIGINT) AS "n" FROM a
LEFT JOIN individuals i ON a."Species" = i."Species" AND a."Type" = i."Type" AND a."Status" = i."Status"
GROUP BY ALL""")
def contingency_(spark: SparkSession, sf: str) -> DataFrame:
    return contingency(individuals(spark, sf), ["Species", "Type", "Status"],
                       levels={"Status": ["alive", "dead", "unknown"]})


@query(f"""SELECT o_orderkey,
  {sql_rounded('(o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER ()')} AS "price",
  {sql_rounded('(o_custkey - avg(o_custkey) OVER ()) / stddev_samp(o_custkey) OVER ()')} AS "customer"
FROM orders""")
def zscore_(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    return with_rounded(zscore(df, ["price", "customer"]), "price", "customer")


@query(f"""WITH {INDIVIDUALS_SQL}, m AS (SELECT i.* REPLACE (nullif("Tag", 'new') AS "Tag"), "Plot" % 3 AS b FROM individuals i),
c AS (SELECT b, count(DISTINCT "Tag") + max(CASE WHEN "Tag" IS NULL THEN 1 ELSE 0 END) AS k FROM m WHERE "Year" = 2000 GROUP BY b),
h AS (SELECT b, "Year", count(DISTINCT CASE WHEN "Status" = 'alive' THEN "Tag" END)
  + max(CASE WHEN "Status" = 'alive' AND "Tag" IS NULL THEN 1 ELSE 0 END) AS s FROM m GROUP BY b, "Year")
SELECT CAST(h.b AS INTEGER) AS "Block", h."Year", CAST(s AS BIGINT) AS "survived", CAST(k AS BIGINT) AS "n_cohort",
  {sql_rounded('s / k')} AS "proportion",
  {sql_rounded('CASE WHEN s <= k THEN sqrt((s / k) * (1 - s / k) / k) END')} AS "se"
FROM h LEFT JOIN c ON h.b = c.b""")
def proportion_se_(spark: SparkSession, sf: str) -> DataFrame:
    """Units that have no tag yet count as one unit."""
    df = individuals(spark, sf).withColumns(
        {"Block": F.pmod("Plot", F.lit(3)), "Tag": F.nullif("Tag", F.lit("new"))})
    stats = proportion_se(df, ["Block", "Year"], "Tag", F.col("Status") == "alive", ["Block"],
                          cohort=F.col("Year") == 2000)
    return with_rounded(stats, "proportion", "se").select(
        "Block", "Year", "survived", "n_cohort", "proportion",
        F.when(F.col("survived") <= F.col("n_cohort"), F.col("se")).alias("se"))


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Plot", "Tag", "Year", CAST(count(*) AS BIGINT) AS "n" FROM individuals GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys_(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_keys(individuals(spark, sf), ["Plot", "Tag", "Year"])


@query(f"""WITH {PLOTS_SQL} SELECT DISTINCT "Plot", "BurnTreat", "Drought" FROM plots""")
def distinct_rows_(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_rows(plots(spark, sf), ["Plot", "BurnTreat", "Drought"])


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Year", CAST(count(*) AS BIGINT) AS "n", CAST(count(*) FILTER ("Status" = 'alive') AS BIGINT) AS "alive",
  {sql_rounded('''count(*) FILTER ("Status" = 'alive') / count(*)''')} AS "alive_rate",
  CAST(count(*) FILTER ("Status" = 'dead') AS BIGINT) AS "dead",
  {sql_rounded('''count(*) FILTER ("Status" = 'dead') / count(*)''')} AS "dead_rate"
FROM individuals GROUP BY "Year" """)
def rates_(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("Status")
    stats = rates(individuals(spark, sf), ["Year"], {"alive": status == "alive", "dead": status == "dead"})
    return with_rounded(stats, "alive_rate", "dead_rate")


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT CAST(count(*) FILTER ("Status" IS NULL) AS BIGINT) AS "Status",
  CAST(count(*) FILTER ("Notes" IS NULL) AS BIGINT) AS "Notes" FROM individuals""")
def null_count_(spark: SparkSession, sf: str) -> DataFrame:
    return null_count(individuals(spark, sf), "Status", "Notes")


@query(f"""WITH {PLOTS_SQL}
SELECT CASE WHEN l_shipdate >= DATE '1996-04-01' AND l_shipdate < DATE '1997-05-01' THEN '1996-1997'
            WHEN l_shipdate >= DATE '1997-05-01' AND l_shipdate < DATE '1998-04-30' THEN '1997-1998' END AS "Season",
  "BurnTreat", "Drought", "Depth", {sql_rounded('avg("Biomass")')} AS "mean",
  {sql_rounded('stddev_samp("Biomass") / sqrt(count(*))')} AS "se" FROM plots
WHERE l_shipdate >= DATE '1996-04-01' AND l_shipdate < DATE '1998-04-30' GROUP BY ALL""")
def season_mean_se(spark: SparkSession, sf: str) -> DataFrame:
    df = plots(spark, sf).withColumn("Season", season("l_shipdate", SEASONS))
    stats = mean_se(df.where(F.col("Season").isNotNull()),
                    ["Season", "BurnTreat", "Drought", "Depth"], "Biomass")
    return with_rounded(stats.drop("sd", "n"), "mean", "se")


@query(f"""WITH {SENSORS_SQL}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", "BurnTreat", "Drought", coalesce("Depth", 'profile') AS "Depth",
  {sql_rounded('avg("VWC")')} AS "mean", {sql_rounded('stddev_samp("VWC") / sqrt(count(*))')} AS "se"
FROM sensors GROUP BY ALL""")
def daily_mean_se(spark: SparkSession, sf: str) -> DataFrame:
    df = sensors(spark, sf).fillna("profile", ["Depth"]).withColumn(
        "day", as_date("ts").cast("string"))
    stats = mean_se(df, ["day", "BurnTreat", "Drought", "Depth"], "VWC")
    return with_rounded(stats.drop("sd", "n"), "mean", "se")


@query(f"""WITH {SENSORS_SQL}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", "Plot", "BurnTreat", "Drought",
  {sql_rounded('avg("VWC")')} AS "VWC_profile",
  CAST(year(CAST(ts AS DATE)) + CASE WHEN month(CAST(ts AS DATE)) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS "Water_Year"
FROM sensors GROUP BY "Plot", "BurnTreat", "Drought", CAST(ts AS DATE)""")
def entity_daily_mean(spark: SparkSession, sf: str) -> DataFrame:
    df = sensors(spark, sf).withColumn("date", as_date("ts"))
    means = entity_mean(df, ["date", "Plot", "BurnTreat", "Drought"], "VWC", "VWC_profile")
    return with_rounded(means, "VWC_profile").select(
        F.col("date").cast("string").alias("day"), "Plot", "BurnTreat", "Drought", "VWC_profile",
        water_year("date").alias("Water_Year"))


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Plot", "Tag", "Year", min("Year") OVER (PARTITION BY "Plot", "Tag") AS "FirstYear" FROM individuals""")
def first_seen_(spark: SparkSession, sf: str) -> DataFrame:
    return first_seen(individuals(spark, sf).select("Plot", "Tag", "Year"), ["Plot", "Tag"], "Year")


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT DISTINCT * FROM (SELECT "Plot", "Tag", "Species", "Year", "Status" FROM individuals
  QUALIFY "Year" = min("Year") OVER (PARTITION BY "Plot", "Tag", "Species"))""")
def earliest_rows_(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).select("Plot", "Tag", "Species", "Year", "Status")
    return earliest_rows(df, ["Plot", "Tag", "Species"], "Year")


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Plot", "Tag", "Year", "Status" FROM individuals
QUALIFY max(CASE WHEN "Year" = 2000 AND "Status" = 'alive' THEN 1 ELSE 0 END) OVER (PARTITION BY "Plot", "Tag") = 1""")
def keep_groups_any_(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).select("Plot", "Tag", "Year", "Status")
    return keep_groups_any(df, ["Plot", "Tag"], (F.col("Year") == 2000) & (F.col("Status") == "alive"))
