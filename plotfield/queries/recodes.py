"""Queries for recoding, labels, dates and missing-value rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotfield.functions import (
    any3, as_date, band, cols_with_prefix, count_distinct_with_missing, density, interaction_key, is_in,
    label_pairs, level_rank, levels, lookup, non_numeric, not_in, overwrite_when, parity,
    parse_subplot, paste, recode, remove_first, to_number, underscores_to_spaces, water_year,
    with_error_bounds, with_levels,
)
from plotfield.operators import arrange, first_rows, mean_se, with_position
from plotfield.queries.registry import query, rounded, sql_rounded, with_rounded
from plotfield.queries.tables import (
    BURN, BURN_SQL, DROUGHT_SQL, INDIVIDUALS_SQL, PLOTS_SQL, SENSORS_SQL, individuals, load,
    plots, sensors,
)


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Plot", "Year", "Tag",
       CASE "Species" WHEN 'DW' THEN 'AG' WHEN 'YS' THEN 'EC' ELSE "Species" END AS "Species"
FROM individuals""")
def recode_keep(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).select("Plot", "Year", "Tag", "Species")
    return df.withColumn("Species", recode("Species", {"DW": "AG", "YS": "EC"}))


@query(f"""SELECT s_suppkey, CAST(s_suppkey % 40 + 1 AS BIGINT) AS "Plot",
  {BURN_SQL.format('(s_suppkey % 40 + 1)')} AS "BurnTreat",
  {DROUGHT_SQL.format('(s_suppkey % 40 + 1)')} AS "Drought" FROM supplier""")
def band_parity(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "supplier").select(
        "s_suppkey", (F.pmod("s_suppkey", F.lit(40)) + 1).alias("Plot"))
    return df.withColumns({"BurnTreat": band("Plot", BURN),
                           "Drought": parity("Plot", "Drought", "Ambient")})


@query(f"""WITH {PLOTS_SQL}
SELECT l_orderkey, l_linenumber,
  CASE WHEN "BurnTreat" = 'Moderate_Burn' AND "Drought" = 'Ambient' THEN 'Moderate Burn Ambient'
       WHEN "BurnTreat" = 'Moderate_Burn' AND "Drought" = 'Drought' THEN 'Moderate Burn Drought'
       WHEN "BurnTreat" = 'Severe_Burn' AND "Drought" = 'Ambient' THEN 'Severe Burn Ambient'
       WHEN "BurnTreat" = 'Severe_Burn' AND "Drought" = 'Drought' THEN 'Severe Burn Drought' END
    AS "TreatmentLabel"
FROM plots""")
def label_pairs_(spark: SparkSession, sf: str) -> DataFrame:
    labels = {(b, d): f"{b.replace('_', ' ')} {d}"
              for b in ("Moderate_Burn", "Severe_Burn") for d in ("Ambient", "Drought")}
    return plots(spark, sf).select(
        "l_orderkey", "l_linenumber",
        label_pairs("BurnTreat", "Drought", labels).alias("TreatmentLabel"))


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Plot", "Year", "Tag", "Notes" FROM individuals
WHERE "Year" = 2000 AND ("Notes" IS NULL OR "Notes" NOT IN ('new', 'new_large'))""")
def not_in_nullsafe(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf)
    return df.where((F.col("Year") == 2000) & not_in("Notes", ["new", "new_large"])).select(
        "Plot", "Year", "Tag", "Notes")


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Plot", "Tag", "Notes" IS NOT NULL AND "Notes" IN ('new', 'new_large') AS "is_new"
FROM individuals WHERE "Status" = 'dead' AND "Species" = 'SM'""")
def filter_membership(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).where((F.col("Status") == "dead") & (F.col("Species") == "SM"))
    return df.select("Plot", "Tag", is_in("Notes", ["new", "new_large"]).alias("is_new"))


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Plot", "Year", "Tag", coalesce("Exclosure", 'no') AS "Exclosure",
       CAST(coalesce(TRY_CAST("Tag" AS INTEGER), 0) AS INTEGER) AS "TagNumber" FROM individuals""")
def fill_missing(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).select(
        "Plot", "Year", "Tag", "Exclosure", to_number("Tag", "int").alias("TagNumber"))
    return df.fillna({"Exclosure": "no", "TagNumber": 0})


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT DISTINCT "Tag" FROM individuals WHERE NOT regexp_matches("Tag", '^-?\\d*(\\.\\d+)?$')""")
def non_numeric_(spark: SparkSession, sf: str) -> DataFrame:
    return non_numeric(individuals(spark, sf), "Tag")


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Tag", CASE WHEN "Tag" NOT LIKE '%D' THEN TRY_CAST("Tag" AS DOUBLE) END AS "TagNumber", CAST(count(*) AS BIGINT) AS n
FROM (SELECT CASE WHEN "Tag" LIKE '%7' THEN "Tag" || 'D' ELSE "Tag" END AS "Tag" FROM individuals) GROUP BY ALL""")
def tolerant_cast(spark: SparkSession, sf: str) -> DataFrame:
    """Codes like ``17D``, which a cast would read as 17, are no numbers."""
    code = F.when(F.col("Tag").endswith("7"), F.concat("Tag", F.lit("D"))).otherwise(F.col("Tag"))
    df = individuals(spark, sf).select(code.alias("Tag")).withColumn("TagNumber", to_number("Tag"))
    return df.groupBy("Tag", "TagNumber").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN code LIKE '%E' THEN 'Enclosed' ELSE 'Not Enclosed' END AS "Exclosure",
  TRY_CAST(regexp_replace(code, '[OE]', '') AS INTEGER) AS "Plot"
FROM (SELECT o_orderkey, CAST(o_custkey % 36 + 1 AS VARCHAR) ||
        CASE WHEN o_orderkey % 2 = 0 THEN 'E' ELSE 'O' END AS code FROM orders)""")
def subplot_parse(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat((F.pmod("o_custkey", F.lit(36)) + 1).cast("string"),
                    F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "E").otherwise("O"))
    df = load(spark, sf, "orders").select("o_orderkey", code.alias("code"))
    parsed = parse_subplot(df, "code", "OE", "E", "Enclosed", "Not Enclosed")
    return parsed.select("o_orderkey", "Exclosure", "Plot")


@query("""SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '') AS "first_gone",
  regexp_replace(p_name, '[aeiou]', '', 'g') AS "all_gone",
  contains(p_name, 'ring') AS "has_ring", p_name LIKE '%widget' AS "is_widget" FROM part""")
def text_patterns(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("p_name")
    return load(spark, sf, "part").select(
        "p_partkey", remove_first("p_name", "[aeiou]").alias("first_gone"),
        F.regexp_replace(name, "[aeiou]", "").alias("all_gone"),
        name.contains("ring").alias("has_ring"), name.endswith("widget").alias("is_widget"))


@query(f"""WITH {SENSORS_SQL}
SELECT event_id, "BurnTreat" || '.' || "Drought" || '.' || "Depth" AS "key",
  coalesce("BurnTreat", 'NA') || '_' || coalesce("Depth", 'NA') AS "pasted",
  replace("BurnTreat", '_', ' ') AS "label" FROM sensors""")
def interaction_key_(spark: SparkSession, sf: str) -> DataFrame:
    return sensors(spark, sf).select(
        "event_id", interaction_key("BurnTreat", "Drought", "Depth").alias("key"),
        paste("BurnTreat", "Depth", sep="_").alias("pasted"),
        underscores_to_spaces("BurnTreat").alias("label"))


@query(f"""WITH {SENSORS_SQL}
SELECT DISTINCT "Depth" FROM sensors WHERE "Depth" IS NOT NULL""")
def factor_levels(spark: SparkSession, sf: str) -> DataFrame:
    return levels(sensors(spark, sf), "Depth")


@query(f"""WITH {SENSORS_SQL},
g AS (SELECT CASE WHEN "Depth" IN ('click', 'signup', 'purchase') THEN "Depth" END AS "Depth",
  CAST(CASE "Depth" WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END AS DOUBLE)
    AS "rank", CAST(count(*) AS BIGINT) AS n FROM sensors GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY "rank" NULLS LAST) AS "position" FROM g""")
def levels_sorted(spark: SparkSession, sf: str) -> DataFrame:
    declared = ["click", "signup", "purchase"]
    df = with_levels(sensors(spark, sf), "Depth", declared)
    counts = df.groupBy("Depth").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", level_rank("Depth", declared).cast("double"))
    return arrange(with_position(ranked, "rank"), "position").select("Depth", "rank", "n", "position")


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Plot", "Year", "Tag",
  CASE WHEN "Year" = 2000 AND "Species" = 'DW' THEN 'alive'
       WHEN NOT ("Year" = 2000 AND "Species" = 'DW') THEN "Status" END AS "Status"
FROM individuals""")
def overwrite_when_(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).select("Plot", "Year", "Tag", "Species", "Status")
    hit = (F.col("Year") == 2000) & (F.col("Species") == "DW")
    return overwrite_when(df, "Status", hit, "alive").drop("Species")


@query(f"""WITH {PLOTS_SQL}
SELECT l_orderkey, l_linenumber,
  CASE "BurnTreat" WHEN 'Moderate_Burn' THEN 'moderate' WHEN 'Severe_Burn' THEN 'severe' END AS "short"
FROM plots""")
def lookup_(spark: SparkSession, sf: str) -> DataFrame:
    short = lookup("BurnTreat", {"Moderate_Burn": "moderate", "Severe_Burn": "severe"})
    return plots(spark, sf).select("l_orderkey", "l_linenumber", short.alias("short"))


@query(f"""WITH {PLOTS_SQL}
SELECT l_orderkey, l_linenumber,
  {sql_rounded('''"Biomass" / CASE WHEN "Exclosure" = 'F' THEN 0.5 ELSE 9.0 END''')} AS "density",
  {sql_rounded('ln(1 + "Cover")')} AS "log_cover" FROM plots""")
def density_(spark: SparkSession, sf: str) -> DataFrame:
    return plots(spark, sf).select(
        "l_orderkey", "l_linenumber",
        rounded(density("Biomass", "Exclosure", {"F": 0.5}, 9.0)).alias("density"),
        rounded(F.log1p("Cover")).alias("log_cover"))


@query(f"""WITH {PLOTS_SQL}
SELECT "BurnTreat", {sql_rounded('avg("Biomass") - stddev_samp("Biomass") / sqrt(count(*))')} AS "lower",
  {sql_rounded('avg("Biomass") + stddev_samp("Biomass") / sqrt(count(*))')} AS "upper"
FROM plots GROUP BY "BurnTreat" """)
def with_error_bounds_(spark: SparkSession, sf: str) -> DataFrame:
    stats = mean_se(plots(spark, sf), ["BurnTreat"], "Biomass")
    return with_rounded(with_error_bounds(stats, "mean", "se"), "lower", "upper").select(
        "BurnTreat", "lower", "upper")


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Plot", "Year",
  CASE WHEN bool_or("Status" = 'alive') THEN TRUE
       WHEN count(*) FILTER ("Status" IS NULL) > 0 THEN NULL ELSE FALSE END AS "any_alive",
  CAST(count(DISTINCT "Species") + max(CASE WHEN "Species" IS NULL THEN 1 ELSE 0 END) AS BIGINT)
    AS "n_species"
FROM individuals GROUP BY "Plot", "Year" """)
def any3_(spark: SparkSession, sf: str) -> DataFrame:
    return individuals(spark, sf).groupBy("Plot", "Year").agg(
        any3(F.col("Status") == "alive").alias("any_alive"),
        count_distinct_with_missing("Species").alias("n_species"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "day",
  CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS "Water_Year"
FROM orders""")
def water_year_(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(
        "o_orderkey", as_date("o_orderdate").cast("string").alias("day"),
        water_year("o_orderdate").alias("Water_Year"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS "position" FROM orders
ORDER BY o_totalprice, o_orderkey LIMIT 20""")
def first_rows_(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return with_position(first_rows(df, 20, ["o_totalprice", "o_orderkey"]), "o_totalprice", "o_orderkey")


@query(f"""WITH {INDIVIDUALS_SQL}
SELECT "Plot", "Tag", "Year", "Status", row_number() OVER (ORDER BY "Plot", "Tag", "Year", "Status" NULLS LAST) AS "position" FROM individuals""")
def sorted_panel(spark: SparkSession, sf: str) -> DataFrame:
    df = individuals(spark, sf).select("Plot", "Tag", "Year", "Status")
    return with_position(df, "Plot", "Tag", "Year", "Status")


@query("""SELECT o_orderkey AS "key", o_totalprice AS "price", o_orderdate IS NULL AS "undated", '2023' AS "Year",
  o_orderkey AS "o_key_copy" FROM orders""")
def column_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Rename, drop, constant column, and selection by name prefix."""
    df = load(spark, sf, "orders").drop("o_custkey", "o_orderpriority")
    df = df.withColumnsRenamed({"o_orderkey": "key", "o_totalprice": "price"})
    df = df.withColumns({"undated": F.col("o_orderdate").isNull(), "Year": F.lit("2023"),
                         "o_key_copy": F.col("key")})
    return df.select("key", "price", "undated", "Year", *cols_with_prefix(df, "o_key"))


@query(f"""WITH {SENSORS_SQL}
SELECT 'enclosed' AS "part", event_id, "VWC" FROM sensors WHERE "Depth" = 'click' AND "Plot" <= 24
UNION ALL SELECT 'open', event_id, "VWC" FROM sensors WHERE NOT ("Depth" = 'click' AND "Plot" <= 24)""")
def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Two subsets by a mask; rows whose mask is missing belong to neither."""
    df = sensors(spark, sf)
    mask = (F.col("Depth") == "click") & (F.col("Plot") <= 24)
    first = df.where(mask).select(F.lit("enclosed").alias("part"), "event_id", "VWC")
    return first.unionByName(df.where(~mask).select(F.lit("open").alias("part"), "event_id", "VWC"))
