"""Field-experiment views of the given tables, in Spark and as SQL common table expressions.

Line items play the plot measurements, orders the tagged individuals, events the sensors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotfield.functions import band, parity, recode
from plotfield.operators.panel import Panel

BURN = [(1, 12, "Moderate_Burn"), (13, 24, "Severe_Burn"), (25, 36, "Unburned")]
BURN_SQL = ("CASE WHEN {0} BETWEEN 1 AND 12 THEN 'Moderate_Burn' "
            "WHEN {0} BETWEEN 13 AND 24 THEN 'Severe_Burn' "
            "WHEN {0} BETWEEN 25 AND 36 THEN 'Unburned' END")
DROUGHT_SQL = "CASE WHEN {0} % 2 = 1 THEN 'Drought' ELSE 'Ambient' END"
NEW_NOTES = ["new", "new_large"]
COHORT_YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
PANEL = Panel()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_treatments(df: DataFrame, plot: str = "Plot") -> DataFrame:
    return df.withColumns({"BurnTreat": band(plot, BURN),
                           "Drought": parity(plot, "Drought", "Ambient")})


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot measurements."""
    df = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate",
        (F.pmod("l_partkey", F.lit(36)) + 1).cast("int").alias("Plot"),
        F.year("l_shipdate").alias("Year"),
        F.col("l_linestatus").alias("Exclosure"),
        F.col("l_returnflag").alias("Depth"),
        F.col("l_quantity").alias("Biomass"),
        F.col("l_extendedprice").alias("Cover"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("Litter"),
        F.col("l_discount").alias("Severity"),
        "l_tax",
    )
    return with_treatments(df)


PLOTS_SQL = f"""plots AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, "Plot", "Year", "Exclosure", "Depth",
         "Biomass", "Cover", "Litter", "Severity", l_tax,
         {BURN_SQL.format('"Plot"')} AS "BurnTreat", {DROUGHT_SQL.format('"Plot"')} AS "Drought"
  FROM (SELECT *, CAST(l_partkey % 36 + 1 AS INTEGER) AS "Plot",
               CAST(year(l_shipdate) AS INTEGER) AS "Year", l_linestatus AS "Exclosure",
               l_returnflag AS "Depth", l_quantity AS "Biomass", l_extendedprice AS "Cover",
               CASE WHEN l_tax > 0 THEN l_tax END AS "Litter", l_discount AS "Severity"
        FROM lineitem))"""


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged individuals as sighted."""
    customer = F.col("o_custkey")
    tag = F.pmod("o_orderkey", F.lit(500))
    return load(spark, sf_dir, "orders").select(
        (F.pmod(customer, F.lit(36)) + 1).cast("int").alias("Plot"),
        F.year("o_orderdate").alias("Year"),
        F.when(tag == 0, F.lit("new")).otherwise(tag.cast("string")).alias("Tag"),
        recode(F.pmod(customer, F.lit(5)), {0: "DW", 1: "YS", 2: "SM", 3: "ML"},
               default=None).alias("Species"),
        recode(F.pmod(customer, F.lit(4)), {0: "seedling", 1: "seedling", 2: "resprout"},
               default=None).alias("Type"),
        recode("o_orderstatus", {"F": "dead", "O": "alive"}, default=None).alias("Status"),
        recode(F.pmod(customer, F.lit(3)), {0: "yes", 2: "no"}, default=None).alias("Exclosure"),
        recode("o_orderpriority",
               {"1-URGENT": "new", "2-HIGH": "new_large", "3-MEDIUM": "massive"},
               default=None).alias("Notes"),
    )


INDIVIDUALS_SQL = """individuals AS (
  SELECT CAST(o_custkey % 36 + 1 AS INTEGER) AS "Plot", CAST(year(o_orderdate) AS INTEGER) AS "Year",
         CASE WHEN o_orderkey % 500 = 0 THEN 'new' ELSE CAST(o_orderkey % 500 AS VARCHAR) END AS "Tag",
         CASE o_custkey % 5 WHEN 0 THEN 'DW' WHEN 1 THEN 'YS' WHEN 2 THEN 'SM' WHEN 3 THEN 'ML' END
           AS "Species",
         CASE o_custkey % 4 WHEN 0 THEN 'seedling' WHEN 1 THEN 'seedling' WHEN 2 THEN 'resprout' END
           AS "Type",
         CASE o_orderstatus WHEN 'F' THEN 'dead' WHEN 'O' THEN 'alive' END AS "Status",
         CASE o_custkey % 3 WHEN 0 THEN 'yes' WHEN 2 THEN 'no' END AS "Exclosure",
         CASE o_orderpriority WHEN '1-URGENT' THEN 'new' WHEN '2-HIGH' THEN 'new_large'
           WHEN '3-MEDIUM' THEN 'massive' END AS "Notes"
  FROM orders)"""


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings, long: timestamp, plot, depth, value."""
    df = load(spark, sf_dir, "events").select(
        "event_id", "ts", (F.pmod("user_id", F.lit(36)) + 1).cast("int").alias("Plot"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("Depth"),
        F.col("value").alias("VWC"), "props",
    )
    return with_treatments(df)


SENSORS_SQL = f"""sensors AS (
  SELECT event_id, ts, "Plot", "Depth", "VWC", props,
         {BURN_SQL.format('"Plot"')} AS "BurnTreat", {DROUGHT_SQL.format('"Plot"')} AS "Drought"
  FROM (SELECT event_id, ts, CAST(user_id % 36 + 1 AS INTEGER) AS "Plot",
               CASE WHEN event_type <> 'view' THEN event_type END AS "Depth", value AS "VWC", props
        FROM events))"""
