"""Queries for joins, grids, unions and reshaping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotfield.functions import cols_with_prefix
from plotfield.operators import (
    add_baseline, anti_join, complete, grid_over, inner_join, left_join, longer, longer_values,
    lookup_join, mean_se, member_flag, semi_join, separate, summarise_across, union_fill,
    union_strict, wider,
)
from plotfield.queries.registry import query, sql_rounded, with_rounded
from plotfield.queries.tables import (
    BURN_SQL, DROUGHT_SQL, INDIVIDUALS_SQL, PLOTS_SQL, SENSORS_SQL, individuals, load, plots,
    sensors, with_treatments,
)
from plotfield.session import shared_folder
from plotfield.sources import read_table, read_wide


@query("""SELECT CAST(o_orderkey AS INTEGER) AS "Plot #", CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS "Status",
  CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice END AS "Cover" FROM orders""")
def read_table_(spark: SparkSession, sf: str) -> DataFrame:
    """A delimited sheet with padded fields, ``NA`` marks and stray text, read back."""
    path = f"{shared_folder(spark)}/sheet-{uuid.uuid4().hex}"
    load(spark, sf, "orders").select(
        F.col("o_orderkey").alias(" Plot # "),
        F.when(F.col("o_orderstatus") == "P", "NA").otherwise(
            F.concat("o_orderstatus", F.lit(" "))).alias("Status "),
        F.when(F.pmod("o_custkey", F.lit(7)) == 0, "#DIV/0!").otherwise(
            F.col("o_totalprice").cast("string")).alias("Cover"),
    ).write.csv(path, header=True, ignoreTrailingWhiteSpace=False)
    return read_table(spark, path, "`Plot #` int, Status string, Cover double")


@query(f"""WITH {PLOTS_SQL}
SELECT p.l_orderkey, p.l_linenumber, p."Biomass", s.s_acctbal AS aspect
FROM plots p JOIN supplier s ON p.l_suppkey = s.s_suppkey""")
def inner_join_(spark: SparkSession, sf: str) -> DataFrame:
    aspect = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("aspect"))
    measured = plots(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", "Biomass")
    return inner_join(measured, aspect, "l_suppkey").drop("l_suppkey")


@query("""SELECT o_orderkey, o_custkey AS "cust", o_totalprice AS "balance_x", c_acctbal AS "balance_y", o_orderstatus AS "label_x", c_mktsegment AS "label_y"
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def join_collision(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that both sides have keep apart by suffixes; the key stays one column."""
    orders = load(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("balance"), F.col("o_orderstatus").alias("label"))
    customers = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("label"))
    return left_join(orders, customers, "cust", suffixes=("_x", "_y"))


@query("""SELECT c_custkey, c_nationkey AS "nation", c_acctbal AS "balance_x", coalesce(s.total, 0.0::DOUBLE) AS "balance"
FROM customer LEFT JOIN (SELECT s_nationkey, round(sum(s_acctbal), 4) AS total FROM supplier GROUP BY s_nationkey) s ON c_nationkey = s_nationkey""")
def complete_collision(spark: SparkSession, sf: str) -> DataFrame:
    """A placeholder column of the design gives way to the facts of its name; where there are none, zero."""
    design = load(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance_x"), F.lit(0.0).alias("balance"))
    facts = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.round(F.sum("s_acctbal"), 4).alias("balance"))
    return complete(design, facts, "nation", 0.0)


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT i."Plot", i."Year", i."Tag", t.area FROM individuals i
LEFT JOIN (VALUES ('yes', 0.5::DOUBLE), ('no', 9.0::DOUBLE), (NULL, 1.0::DOUBLE)) t(e, area)
  ON i."Exclosure" IS NOT DISTINCT FROM t.e""")
def left_join_lookup(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).select("Plot", "Year", "Tag", "Exclosure")
    areas = [("yes", 0.5), ("no", 9.0), (None, 1.0)]
    return lookup_join(df, areas, "Exclosure string, area double", "Exclosure").drop("Exclosure")


@query(f"""WITH {INDIVIDUALS_SQL},
c AS (SELECT "Plot", "Year", "Species", CAST(count(*) AS BIGINT) AS n FROM individuals GROUP BY ALL)
SELECT i."Plot", i."Year", i."Species", i."Tag", c.n FROM individuals i LEFT JOIN c
  ON i."Plot" = c."Plot" AND i."Year" = c."Year" AND i."Species" IS NOT DISTINCT FROM c."Species" """)
def left_join_composite(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).select("Plot", "Year", "Species", "Tag")
    keys = ["Plot", "Year", "Species"]
    return left_join(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Plot", "Year", "Tag", "Species", "Type" FROM individuals d WHERE "Year" = 2001 AND NOT EXISTS (
  SELECT 1 FROM individuals p WHERE p."Year" = 2000
    AND p."Plot" IS NOT DISTINCT FROM d."Plot" AND p."Tag" IS NOT DISTINCT FROM d."Tag"
    AND p."Species" IS NOT DISTINCT FROM d."Species" AND p."Type" IS NOT DISTINCT FROM d."Type")""")
def anti_join_nullsafe(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).select("Plot", "Year", "Tag", "Species", "Type")
    return anti_join(df.where("Year = 2001"), df.where("Year = 2000"),
                     ["Plot", "Tag", "Species", "Type"])


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Plot", "Year", "Tag", "Species" FROM individuals d WHERE EXISTS (
  SELECT 1 FROM individuals p WHERE p."Year" = 1999 AND p."Type" = 'seedling'
    AND p."Plot" = d."Plot" AND p."Species" IS NOT DISTINCT FROM d."Species"
    AND p."Tag" = d."Tag")""")
def semi_join_(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).select("Plot", "Year", "Tag", "Species", "Type")
    roster = df.where("Year = 1999 and Type = 'seedling'")
    return semi_join(df, roster, ["Plot", "Species", "Tag"]).drop("Type")


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Plot", "Year", "Tag", "Tag" IN (SELECT "Tag" FROM individuals
  WHERE "Year" = 2001 AND "Status" = 'dead' AND "Type" = 'resprout') AS "flag" FROM individuals""")
def member_flag_(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).select("Plot", "Year", "Tag", "Status", "Type")
    dead = df.where("Year = 2001 and Status = 'dead' and Type = 'resprout'")
    return member_flag(df, dead, "Tag", "flag").drop("Status", "Type")


@query(f"""SELECT DISTINCT CAST(s_suppkey % 36 + 1 AS INTEGER) AS "Plot", y.y AS "Year", e.e AS "Exclosure",
  {BURN_SQL.format('(s_suppkey % 36 + 1)')} AS "BurnTreat", {DROUGHT_SQL.format('(s_suppkey % 36 + 1)')} AS "Drought"
FROM supplier, (VALUES (2000), (2001)) y(y), (VALUES ('no'), ('yes')) e(e)""")
def design_grid(spark: SparkSession, sf: str) -> DataFrame:
    plots_seen = load(spark, sf, "supplier").select(
        (F.pmod("s_suppkey", F.lit(36)) + 1).cast("int").alias("Plot")).distinct()
    return with_treatments(
        grid_over(plots_seen, {"Year": [2000, 2001], "Exclosure": ["no", "yes"]}))


@query(f"""WITH {INDIVIDUALS_SQL},
g AS (SELECT * FROM (SELECT DISTINCT "Plot" FROM individuals), (SELECT unnest(range(1995, 2003)) AS "Year")),
c AS (SELECT "Plot", "Year", count(*) AS n FROM individuals
      WHERE "Type" = 'seedling' AND "Species" = 'SM' AND "Notes" = 'massive' GROUP BY ALL)
SELECT g."Plot", CAST(g."Year" AS INTEGER) AS "Year", CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN c ON g."Plot" = c."Plot" AND g."Year" = c."Year" """)
def complete_grid(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf)
    design = grid_over(df.select("Plot").distinct(), {"Year": list(range(1995, 2003))})
    counts = df.where("Type = 'seedling' and Species = 'SM' and Notes = 'massive'").groupBy(
        "Plot", "Year").agg(F.count(F.lit(1)).alias("n"))
    return complete(design, counts, ["Plot", "Year"])


@query("""SELECT o_orderkey AS "key", o_totalprice AS "value", o_orderstatus AS "status", NULL::VARCHAR AS "segment" FROM orders
UNION ALL SELECT c_custkey, c_acctbal, NULL, c_mktsegment FROM customer""")
def union_fill_(spark: SparkSession, sf: str) -> DataFrame:
    first = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"),
        F.col("o_orderstatus").alias("status"))
    second = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"),
        F.col("c_mktsegment").alias("segment"))
    return union_fill(first, second)


@query("""SELECT s_nationkey AS "nation", s_acctbal AS "balance" FROM supplier
UNION ALL SELECT c_nationkey, c_acctbal FROM customer""")
def union_strict_(spark: SparkSession, sf: str) -> DataFrame:
    first = load(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    second = load(spark, sf, "customer").select(
        F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return union_strict(first, second)


@query(f"""WITH {PLOTS_SQL}
SELECT "BurnTreat", "Exclosure", {sql_rounded('avg("Biomass")')} AS "mean",
  {sql_rounded('stddev_samp("Biomass") / sqrt(count(*))')} AS "se"
FROM plots WHERE "BurnTreat" <> 'Unburned' GROUP BY ALL
UNION ALL SELECT * FROM (VALUES ('Unburned', 'F', 0.0::DOUBLE, 0.0::DOUBLE), ('Unburned', 'O', 0.0::DOUBLE, 0.0::DOUBLE))""")
def add_baseline_(spark: SparkSession, sf: str) -> DataFrame:
    burned = plots(spark, sf).where("BurnTreat <> 'Unburned'")
    stats = with_rounded(mean_se(burned, ["BurnTreat", "Exclosure"], "Biomass"), "mean", "se")
    return add_baseline(
        stats.select("BurnTreat", "Exclosure", "mean", "se"),
        [("Unburned", "F", 0.0, 0.0), ("Unburned", "O", 0.0, 0.0)],
        ["BurnTreat", "Exclosure", "mean", "se"])


@query(f"""WITH {PLOTS_SQL}
SELECT l_orderkey, l_linenumber, 'Biomass' AS "name", "Biomass" AS "value" FROM plots
UNION ALL SELECT l_orderkey, l_linenumber, 'Litter', "Litter" FROM plots""")
def longer_(spark: SparkSession, sf: str) -> DataFrame:
    df = plots(spark, sf).select("l_orderkey", "l_linenumber", "Biomass", "Litter")
    return longer(df, cols=["Biomass", "Litter"])


@query("""SELECT c_custkey, m."name", CASE m."name" WHEN 'Status_1' THEN c_mktsegment ELSE c_name END AS "value"
FROM customer, (VALUES ('Status_1'), ('Status_2')) m("name")""")
def longer_prefix_(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("Status_1"), F.col("c_name").alias("Status_2"))
    return longer(df, prefix="Status_")


WIDE_YEARS = range(1995, 2002)  # the years of the plots


def _cover_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """One row per plot with ``percent_cover_<year>`` and ``plot_area_<year>`` columns."""
    df = plots(spark, sf)
    columns = []
    for y in WIDE_YEARS:
        this = F.col("Year") == y
        columns += [F.max(F.when(this, F.col("Cover"))).alias(f"percent_cover_{y}"),
                    F.max(F.when(this, F.col("Biomass"))).alias(f"plot_area_{y}")]
    return df.groupBy("Plot").agg(*columns)


_COVER_LONG_SQL = f"""WITH {PLOTS_SQL}
SELECT "Plot", 'percent_cover' AS "Measurement", CAST("Year" AS VARCHAR) AS "Year", max("Cover") AS "value"
FROM plots GROUP BY ALL
UNION ALL SELECT "Plot", 'plot_area', CAST("Year" AS VARCHAR), max("Biomass")
FROM plots GROUP BY ALL"""


@query(_COVER_LONG_SQL)
def longer_regex_(spark: SparkSession, sf: str) -> DataFrame:
    wide = _cover_by_year(spark, sf)
    return longer(wide, cols=cols_with_prefix(wide, "percent_cover", "plot_area"),
                  names_pattern="(.*)_(.*)", names_to=["Measurement", "Year"])


@query(f"""WITH {PLOTS_SQL}
SELECT "Plot", CAST("Year" AS VARCHAR) AS "Year", max("Cover") AS "percent_cover", max("Biomass") AS "plot_area"
FROM plots GROUP BY ALL""")
def wider_(spark: SparkSession, sf: str) -> DataFrame:
    return wider(longer_regex_(spark, sf), ["Plot", "Year"], "Measurement", "value")


@query(f"""WITH {INDIVIDUALS_SQL},
s AS (SELECT "Plot", "Year", "Tag", max("Status") AS st FROM individuals GROUP BY ALL)
SELECT "Plot", "Tag", {", ".join(f"""max(CASE WHEN "Year" = {y} THEN st END) AS "Status_{y}" """ for y in WIDE_YEARS)}
FROM s GROUP BY ALL""")
def wider_prefixed_(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).groupBy("Plot", "Tag", "Year").agg(F.max("Status").alias("st"))
    return wider(df, ["Plot", "Tag"], "Year", "st", WIDE_YEARS, prefix="Status_")


@query(f"""WITH {PLOTS_SQL}
SELECT "BurnTreat", 'Biomass' AS "variable", {sql_rounded('avg("Biomass")')} AS "mean",
  {sql_rounded('stddev_samp("Biomass")')} AS "sd" FROM plots GROUP BY "BurnTreat"
UNION ALL SELECT "BurnTreat", 'l_tax', {sql_rounded('avg(l_tax)')}, {sql_rounded('stddev_samp(l_tax)')}
FROM plots GROUP BY "BurnTreat" """)
def longer_values_(spark: SparkSession, sf: str) -> DataFrame:
    wide = summarise_across(plots(spark, sf), ["BurnTreat"], ["Biomass", "l_tax"])
    return with_rounded(longer_values(wide, ["BurnTreat"]), "mean", "sd")


@query(f"""WITH {SENSORS_SQL}
SELECT event_id, split_part(code, '_', 2) AS "Plot", CASE WHEN "Depth" IS NOT NULL THEN split_part(code, '_', 3) END AS "Depth"
FROM (SELECT event_id, "Depth", 'VWC_' || "Plot" || CASE WHEN "Depth" IS NULL THEN '' ELSE '_' || "Depth" END AS code FROM sensors)""")
def separate_(spark: SparkSession, sf: str) -> DataFrame:
    depth = F.coalesce(F.concat(F.lit("_"), F.col("Depth")), F.lit(""))
    df = sensors(spark, sf).select(
        "event_id", F.concat(F.lit("VWC_"), F.col("Plot").cast("string"), depth).alias("code"))
    return separate(df, "code", [None, "Plot", "Depth"], "_")


@query(f"""WITH {SENSORS_SQL}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", CAST("Plot" AS VARCHAR) AS "Plot", "Depth",
  {sql_rounded('avg("VWC")')} AS "VWC" FROM sensors GROUP BY ALL""")
def wide_sensor_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """A wide sheet (one column per sensor) turned long, its column names split."""
    code = F.concat(F.lit("VWC_"), F.col("Plot").cast("string"),
                    F.coalesce(F.concat(F.lit("_"), F.col("Depth")), F.lit("")))
    df = sensors(spark, sf).groupBy(F.to_date("ts").cast("string").alias("day"), code.alias("code")).agg(F.avg("VWC").alias("VWC"))
    sheet = wider(df, ["day"], "code", "VWC")
    long = longer(sheet, ids=["day"], name="sensor", value="VWC").where(F.col("VWC").isNotNull())
    return with_rounded(separate(long, "sensor", [None, "Plot", "Depth"], "_"), "VWC").select(
        "day", "Plot", "Depth", "VWC")


@query(f"""WITH {SENSORS_SQL}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", CAST("Plot" AS VARCHAR) AS "Plot", "Depth", {sql_rounded('avg("VWC")')} AS "VWC"
FROM sensors WHERE "VWC" IS NOT NULL GROUP BY ALL""")
def wide_sheet_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A written wide sheet with the means and the counts of every sensor; only the means are read back."""
    code = F.concat(F.col("Plot").cast("string"), F.coalesce(F.concat(F.lit("_"), F.col("Depth")), F.lit("")))
    daily = sensors(spark, sf).groupBy(F.to_date("ts").alias("day"), code.alias("code")).agg(
        F.avg("VWC").alias("VWC"), F.count("VWC").cast("double").alias("N"))
    both = longer(daily, cols=["VWC", "N"], name="kind", value="v").withColumn("sensor", F.concat_ws("_", "kind", "code"))
    path = f"{shared_folder(spark)}/wide-{uuid.uuid4().hex}"
    wider(both, ["day"], "sensor", "v").write.csv(path, header=True)
    sheet = read_wide(spark, path, "day date", r"VWC_(?P<plot>\d+)(_(?P<depth>.+))?")
    long = longer(sheet, ids=["day"], names_pattern=r"VWC_(\d+)(?:_(.+))?", names_to=["Plot", "Depth"], value="VWC")
    return with_rounded(long.where(F.col("VWC").isNotNull()).withColumn("day", F.col("day").cast("string")), "VWC")
