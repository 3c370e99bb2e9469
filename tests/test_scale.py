"""Hot keys, partition invariance and written intermediate tables."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from plotfield.operators import first_seen, mean_se, panel, semi_join
from plotfield.session import settle, shared_folder


@contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 4000)
    return spark.range(0, 120_000, 1, 16).select(
        key.alias("Plot"), (F.col("id") % 7 + 2018).cast("int").alias("Year"),
        F.sha2(F.col("id").cast("string"), 256).alias("note"))


@pytest.mark.parametrize("apply", [
    lambda df: first_seen(df, ["Plot"], "Year"),
    lambda df: semi_join(df, df.where("Year = 2018"), ["Plot"]),
])
def test_rows_of_a_hot_key_are_split_over_tasks(spark, skewed, apply):
    with settings(spark, **SMALL):
        out = apply(skewed)
        count = len(out.collect())
        assert "skew=true" in final_plan(out)
    assert count == skewed.count()


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_partitioning_does_not_change_results(spark, rows, partitions):
    df = spark.range(0, 3000).select(
        (F.col("id") % 13).cast("int").alias("Plot"), (F.col("id") % 91).cast("string").alias("Tag"),
        (F.col("id") % 3 + 2022).cast("int").alias("Year"),
        F.when(F.col("id") % 5 < 2, "dead").when(F.col("id") % 5 < 4, "alive").alias("Status"),
        F.lit("S").alias("Species"), F.lit("seedling").alias("Type"),
        F.when(F.col("id") % 11 == 0, "new").alias("Notes"))

    def reconstruct(frame):
        out = panel.backfill_prior(frame, 2023, ["new"])
        out = panel.revive_earlier(panel.backfill_skipped(out, 2024), 2024)
        members = panel.cohort_members(panel.assign_cohort(out, [2022, 2023, 2024], ["new"], "new"))
        return rows(members.groupBy("Plot", "Cohort", "Status").count())

    assert reconstruct(df.repartition(partitions)) == reconstruct(df.coalesce(2))
    stats = mean_se(df.repartition(partitions), ["Plot"], "Year")
    assert stats.count() == 13


def test_settled_tables_live_in_the_shared_folder(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    copy = settle(df)
    assert rows(copy) == rows(df) and copy.schema == df.schema
    assert shared_folder(spark).split(":")[-1].lstrip("/") in copy.inputFiles()[0]
    assert "FileScan parquet" in final_plan(copy.select("k"))
