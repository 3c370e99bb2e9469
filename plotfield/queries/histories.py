"""Queries for life-history reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotfield.operators import grid_over, panel
from plotfield.queries.registry import query, sql_rounded, with_rounded
from plotfield.queries.tables import (
    BURN_SQL, COHORT_YEARS, DROUGHT_SQL, INDIVIDUALS_SQL, NEW_NOTES, individuals, plots, PLOTS_SQL,
    with_treatments,
)
from plotfield.session import settle

BASE, LATER = 1999, [2000, 2001]

_PRIOR = f"""{INDIVIDUALS_SQL},
prior AS (SELECT * FROM individuals UNION ALL
  SELECT * REPLACE (1999 AS "Year", CASE WHEN "Status" = 'dead' THEN 'alive' ELSE "Status" END AS "Status")
  FROM individuals WHERE "Year" = 2000 AND ("Notes" IS NULL OR "Notes" NOT IN ('new', 'new_large')))"""

_SKIPPED = _PRIOR + """,
dead AS (SELECT * FROM prior WHERE "Year" = 2001 AND "Status" = 'dead'),
skipped AS (SELECT * FROM prior UNION ALL
  SELECT * REPLACE (2000 AS "Year", 'alive' AS "Status") FROM dead d WHERE NOT EXISTS (
    SELECT 1 FROM prior p WHERE p."Year" = 2000 AND p."Plot" = d."Plot" AND p."Tag" = d."Tag"
      AND p."Species" IS NOT DISTINCT FROM d."Species" AND p."Type" IS NOT DISTINCT FROM d."Type"))"""

_PANEL = _SKIPPED + """,
panel AS (SELECT * REPLACE (CASE WHEN "Year" = 2000 AND "Tag" IN (SELECT "Tag" FROM dead)
                            THEN 'alive' ELSE "Status" END AS "Status") FROM skipped)"""

_COHORTS = _PANEL + """,
cohorts AS (SELECT *, CASE WHEN ("Notes" IS NOT NULL AND "Notes" IN ('new', 'new_large')) OR "Tag" = 'new'
    THEN 'Cohort_' || "Year" ELSE 'Cohort_' || "FirstYear" END AS "Cohort"
  FROM (SELECT *, min("Year") OVER (PARTITION BY "Plot", "Tag") AS "FirstYear" FROM panel))"""

_MEMBERS = _COHORTS + """,
members AS (SELECT DISTINCT * FROM (SELECT * FROM cohorts
  QUALIFY "Year" = min("Year") OVER (PARTITION BY "Plot", "Tag", "Species", "Type")))"""

_COUNTS = _MEMBERS + f""",
counts AS (SELECT g."Plot", CAST(g."Year" AS INTEGER) AS "Year",
    {BURN_SQL.format('g."Plot"')} AS "BurnTreat", {DROUGHT_SQL.format('g."Plot"')} AS "Drought",
    CAST(coalesce(c.n, 0) AS BIGINT) AS "Count"
  FROM (SELECT * FROM (SELECT DISTINCT "Plot" FROM individuals), (SELECT unnest(range(1995, 2002)) AS "Year")) g
  LEFT JOIN (SELECT "Plot", "Year", count(*) AS n FROM members WHERE "Type" = 'seedling' GROUP BY ALL) c
    ON g."Plot" = c."Plot" AND g."Year" = c."Year")"""

_HISTORY = _PANEL + """,
roster AS (SELECT "Plot", "Tag", "Exclosure", "Status" AS "Status_1999" FROM panel
  WHERE "Year" = 1999 AND "Type" = 'seedling'),
future AS (SELECT "Plot", "Tag", "Year",
    CASE WHEN bool_or("Status" = 'alive') THEN 'alive' WHEN count(*) > count("Status") THEN NULL ELSE 'dead' END AS st
  FROM panel WHERE "Tag" IN (SELECT "Tag" FROM roster) AND "Year" IN (2000, 2001) GROUP BY ALL),
history AS (SELECT r.*, f."Status_2000", f."Status_2001" FROM roster r LEFT JOIN (
  SELECT "Plot", "Tag", max(CASE WHEN "Year" = 2000 THEN st END) AS "Status_2000",
    max(CASE WHEN "Year" = 2001 THEN st END) AS "Status_2001" FROM future GROUP BY ALL) f
  ON r."Plot" = f."Plot" AND r."Tag" = f."Tag")"""

_MOVES = _HISTORY + f""",
long AS (SELECT "Plot", "Tag", "Exclosure", 1999 AS "Year", "Status_1999" AS st FROM history
  UNION ALL SELECT "Plot", "Tag", "Exclosure", 2000, coalesce("Status_2000", 'dead') FROM history
  UNION ALL SELECT "Plot", "Tag", "Exclosure", 2001, coalesce("Status_2001", 'dead') FROM history),
moves AS (SELECT "Plot", "Tag", {BURN_SQL.format('"Plot"')} AS "BurnTreat", {DROUGHT_SQL.format('"Plot"')} AS "Drought",
    "Year", max(CASE WHEN st = 'alive' THEN 1.0::DOUBLE ELSE 0.0 END) AS "Survival"
  FROM long WHERE "Year" > 1999 GROUP BY ALL)"""

_PANEL_COLUMNS = '"Plot", "Year", "Tag", "Species", "Type", "Status", "Exclosure", "Notes"'


def _prior(spark: SparkSession, sf: str) -> DataFrame:
    return panel.backfill_prior(individuals(spark, sf), 2000, NEW_NOTES)


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return panel.repair(individuals(spark, sf), prior=(2000, NEW_NOTES), skipped=2001, revived=2001)


def _settled_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel, written once because what follows reads it several times."""
    return settle(_panel(spark, sf))


def _cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return panel.assign_cohort(_settled_panel(spark, sf), COHORT_YEARS, NEW_NOTES, "new")


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    design = grid_over(individuals(spark, sf).select("Plot").distinct(), {"Year": COHORT_YEARS})
    members = panel.cohort_members(_cohorts(spark, sf))
    return panel.cohort_counts_complete(members, with_treatments(design), "seedling")


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return panel.survival_history(_settled_panel(spark, sf), BASE, LATER, "seedling", carry=["Exclosure"])


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    filled = _history(spark, sf).fillna("dead", ["Status_2000", "Status_2001"])
    return panel.transitions(with_treatments(filled), LATER, ["BurnTreat", "Drought"])


@query(f"WITH {_PRIOR} SELECT {_PANEL_COLUMNS} FROM prior")
def backfill_prior(spark: SparkSession, sf: str) -> DataFrame:
    return _prior(spark, sf)


@query(f"WITH {_SKIPPED} SELECT {_PANEL_COLUMNS} FROM skipped")
def backfill_skipped(spark: SparkSession, sf: str) -> DataFrame:
    return panel.repair(individuals(spark, sf), prior=(2000, NEW_NOTES), skipped=2001)


@query(f"WITH {_PANEL} SELECT {_PANEL_COLUMNS} FROM panel")
def revive_earlier(spark: SparkSession, sf: str) -> DataFrame:
    return _panel(spark, sf)


@query(f'WITH {_COHORTS} SELECT {_PANEL_COLUMNS}, "FirstYear", "Cohort" FROM cohorts')
def assign_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return _cohorts(spark, sf)


@query(f'WITH {_MEMBERS} SELECT {_PANEL_COLUMNS}, "FirstYear", "Cohort" FROM members')
def cohort_members(spark: SparkSession, sf: str) -> DataFrame:
    return panel.cohort_members(_cohorts(spark, sf))


@query(f'WITH {_MEMBERS} SELECT "Cohort", CAST(count(*) AS BIGINT) AS "n" FROM members GROUP BY ALL')
def cohort_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return panel.cohort_members(_cohorts(spark, sf)).groupBy("Cohort").agg(
        F.count(F.lit(1)).alias("n"))


@query(f"WITH {_COUNTS} SELECT * FROM counts")
def cohort_counts_complete(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


@query(f"""WITH {_COUNTS} SELECT "BurnTreat", "Year", {sql_rounded('avg("Count")')} AS "Mean_Count",
  {sql_rounded('stddev_samp("Count") / sqrt(count(*))')} AS "SE" FROM counts GROUP BY ALL""")
def cohort_summary(spark: SparkSession, sf: str) -> DataFrame:
    return with_rounded(panel.cohort_summary(_counts(spark, sf), ["BurnTreat", "Year"]),
                        "Mean_Count", "SE")


@query(f"WITH {_HISTORY} SELECT * FROM history")
def survival_history(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf)


@query(f"""WITH {_HISTORY} SELECT CAST(count(*) AS BIGINT) AS "n_1999",
  CAST(count(*) FILTER ("Status_2000" = 'alive') AS BIGINT) AS "alive_2000",
  {sql_rounded('''count(*) FILTER ("Status_2000" = 'alive') / count(*)''')} AS "surv_rate_2000",
  CAST(count(*) FILTER ("Status_2001" = 'alive') AS BIGINT) AS "alive_2001",
  {sql_rounded('''count(*) FILTER ("Status_2001" = 'alive') / count(*)''')} AS "surv_rate_2001" FROM history""")
def survival_rates(spark: SparkSession, sf: str) -> DataFrame:
    return with_rounded(panel.survival_rates(_history(spark, sf), BASE, LATER),
                        "surv_rate_2000", "surv_rate_2001")


@query(f"WITH {_MOVES} SELECT * FROM moves")
def transitions(spark: SparkSession, sf: str) -> DataFrame:
    return _moves(spark, sf)


@query(f"""WITH {_MOVES} SELECT "BurnTreat", "Drought", "Year", CAST(count(DISTINCT "Tag") AS BIGINT) AS "n",
  sum("Survival") AS "survived", {sql_rounded('sum("Survival") / count(DISTINCT "Tag")')} AS "survival_rate"
FROM moves GROUP BY ALL""")
def survival_summary(spark: SparkSession, sf: str) -> DataFrame:
    return with_rounded(
        panel.survival_summary(_moves(spark, sf), ["BurnTreat", "Drought", "Year"]),
        "survival_rate")


@query(f"""WITH {_MOVES} SELECT "Plot", "Exclosure", CAST("Year" AS INTEGER) AS "Year", CAST(count(*) AS BIGINT) AS "total",
  CAST(CASE WHEN count(st) = count(*) THEN count(*) FILTER (st = 'alive') END AS DOUBLE) AS "alive",
  {sql_rounded("CASE WHEN count(st) = count(*) THEN count(*) FILTER (st = 'alive') END / count(*)")} AS "survival_rate"
FROM long GROUP BY ALL""")
def survival_by_(spark: SparkSession, sf: str) -> DataFrame:
    filled = _history(spark, sf).fillna("dead", ["Status_2000", "Status_2001"])
    stats = panel.survival_by(filled, ["Plot", "Exclosure"])
    return with_rounded(stats.withColumn("alive", F.col("alive").cast("double")), "survival_rate")


@query(f"""WITH {_PANEL}, {PLOTS_SQL},
cover AS (SELECT "Plot", "Year", CASE "Exclosure" WHEN 'F' THEN 'yes' ELSE 'no' END AS "Exclosure", avg("Cover") AS cover
  FROM plots GROUP BY ALL),
seen AS (SELECT "Plot", "Year", "Exclosure", count(DISTINCT "Tag") AS n FROM panel WHERE "Year" > 1999 GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT "Plot" FROM individuals), (VALUES (2000), (2001)) y("Year"), (VALUES ('no'), ('yes')) e("Exclosure"))
SELECT g."Plot", CAST(g."Year" AS INTEGER) AS "Year", g."Exclosure", {BURN_SQL.format('g."Plot"')} AS "BurnTreat",
  {DROUGHT_SQL.format('g."Plot"')} AS "Drought", {sql_rounded('ln(1 + cover)')} AS "log_cover",
  CAST(coalesce(n, 0) AS BIGINT) AS "total_seedlings",
  {sql_rounded("coalesce(n, 0) / CASE WHEN g.Exclosure = 'yes' THEN 0.5 ELSE 9.0 END")} AS "density"
FROM g LEFT JOIN seen USING ("Plot", "Year", "Exclosure") LEFT JOIN cover USING ("Plot", "Year", "Exclosure")""")
def establishment(spark: SparkSession, sf: str) -> DataFrame:
    seen = individuals(spark, sf).select("Plot").distinct()
    design = with_treatments(grid_over(seen, {"Year": [2000, 2001], "Exclosure": ["no", "yes"]}))
    subplot = F.when(F.col("Exclosure") == "F", "yes").otherwise("no")
    cover = plots(spark, sf).groupBy("Plot", "Year", subplot.alias("Exclosure")).agg(
        F.avg("Cover").alias("cover"))
    stats = panel.establishment(_panel(spark, sf), design, cover, 1999, "Exclosure",
                                {"yes": 0.5}, 9.0, "cover", ["BurnTreat", "Drought"])
    return with_rounded(stats, "log_cover", "density")
