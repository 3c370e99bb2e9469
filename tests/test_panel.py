import random

import pytest
from pyspark.sql import functions as F

from plotfield.operators import grid, panel

SCHEMA = "Plot int, Tag string, Species string, Type string, Year int, Status string, Notes string, Exclosure string"


@pytest.fixture(scope="module")
def sightings(spark):
    return spark.createDataFrame([
        (1, "1", "A", "seedling", 2023, "dead", None, "no"),       # was alive in 2022
        (1, "2", "A", "seedling", 2023, "alive", "new", "no"),     # new: no earlier row
        (1, "3", None, "seedling", 2023, None, "big", "yes"),      # unknown stays unknown
        (2, "4", None, None, 2024, "dead", None, "no"),            # skipped in 2023
        (2, "5", "B", "seedling", 2023, "dead", "new_large", "no"),
        (2, "5", "B", "seedling", 2024, "dead", None, "no"),       # so alive in 2023
        (3, "5", "B", "seedling", 2023, "dead", "new", "no"),      # same tag, other plot
        (3, "new", "B", "seedling", 2024, "alive", None, "no"),
    ], SCHEMA)


@pytest.fixture(scope="module")
def rebuilt(sightings):
    prior = panel.backfill_prior(sightings, 2023, ["new", "new_large"])
    return panel.revive_earlier(panel.backfill_skipped(prior, 2024), 2024)


def test_backfill_prior(sightings, rows):
    out = panel.backfill_prior(sightings, 2023, ["new", "new_large"])
    assert out.columns == sightings.columns
    assert rows(out.where("Year = 2022"), "Plot", "Tag", "Status") == [(1, "1", "alive"), (1, "3", None)]
    assert out.count() == 10


def test_backfill_skipped_matches_missing_keys(sightings, rows):
    out = panel.backfill_skipped(sightings, 2024)
    added = out.subtract(sightings)
    assert rows(added, "Plot", "Tag", "Year", "Status") == [(2, "4", 2023, "alive")]
    present = sightings.union(sightings.where("Tag = '4'").withColumn("Year", F.lit(2023)))
    assert panel.backfill_skipped(present, 2024).count() == present.count()


def test_revive_by_tag_alone_or_by_plot_and_tag(sightings, rows):
    by_tag = panel.revive_earlier(sightings, 2024).where("Year = 2023 and Tag = '5'")
    assert rows(by_tag, "Plot", "Status") == [(2, "alive"), (3, "alive")]
    by_both = panel.revive_earlier(sightings, 2024, keys=["Plot", "Tag"]).where("Year = 2023 and Tag = '5'")
    assert rows(by_both, "Plot", "Status") == [(2, "alive"), (3, "dead")]


def test_repair_equals_its_three_steps(spark, sightings, rows):
    pick = random.Random(3)
    some = lambda *values: pick.choice(values)
    many = spark.createDataFrame([
        (some(1, 2, None), some("1", "2", "new", None), some("A", None), some("seedling", None), some(1950, 2021, 2022, 2023, 2024, 2025, None),
         some("alive", "dead", None), some("new", "big", None), "no") for _ in range(300)], SCHEMA)
    for df in (sightings, many, many.limit(0)):
        for year, later in ((2023, 2024), (2024, 2024), (2023, 2022)):
            steps = panel.backfill_prior(df, year, ["new"])
            assert rows(panel.repair(df, prior=(year, ["new"]))) == rows(steps)
            steps = panel.backfill_skipped(steps, later)
            assert rows(panel.repair(df, prior=(year, ["new"]), skipped=later)) == rows(steps)
            out = panel.repair(df, prior=(year, ["new"]), skipped=later, revived=later, revived_keys=["Plot", "Tag"])
            assert out.schema == df.schema and rows(out) == rows(panel.revive_earlier(steps, later, keys=["Plot", "Tag"]))
            assert rows(panel.repair(df, skipped=later, revived=later)) == rows(panel.revive_earlier(panel.backfill_skipped(df, later), later))
    with pytest.raises(ValueError):
        panel.repair(sightings, revived=2024, keys=["Plot"])


def test_repair_reads_its_source_twice(spark, tmp_path):
    spark.range(3000).selectExpr("int(id % 7) Plot", "string(id % 400) Tag", "'A' Species", "'seedling' Type", "int(2022 + id % 3) Year",
                                 "if(id % 5 = 0, 'dead', 'alive') Status", "string(null) Notes", "'no' Exclosure").write.parquet(str(tmp_path / "p"))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.read.parquet(str(tmp_path / "p")).mapInArrow(counted, SCHEMA)
    panel.repair(df, prior=(2023, ["new"]), skipped=2024, revived=2024).write.format("noop").mode("overwrite").save()
    assert read.value == 2 * 3000


def test_cohorts_and_members(rebuilt, rows):
    cohorts = panel.assign_cohort(rebuilt, [2022, 2023, 2024], ["new", "new_large"], "new")
    assert rows(cohorts, "Plot", "Tag", "Year", "Cohort") == [
        (1, "1", 2022, "Cohort_2022"), (1, "1", 2023, "Cohort_2022"), (1, "2", 2023, "Cohort_2023"),
        (1, "3", 2022, "Cohort_2022"), (1, "3", 2023, "Cohort_2022"), (2, "4", 2023, "Cohort_2023"),
        (2, "4", 2024, "Cohort_2023"), (2, "5", 2023, "Cohort_2023"), (2, "5", 2024, "Cohort_2023"),
        (3, "5", 2023, "Cohort_2023"), (3, "new", 2024, "Cohort_2024")]
    members = panel.cohort_members(cohorts)
    assert rows(members, "Plot", "Tag", "Year") == [
        (1, "1", 2022), (1, "2", 2023), (1, "3", 2022), (2, "4", 2023), (2, "5", 2023),
        (3, "5", 2023), (3, "new", 2024)]
    unknown = panel.assign_cohort(rebuilt, [2024], [], None)
    assert rows(unknown.where("Tag = '1'"), "Cohort") == [(None,), (None,)]


def test_counts_on_full_grid(spark, rebuilt, rows):
    members = panel.cohort_members(panel.assign_cohort(rebuilt, [2022, 2023, 2024], ["new"], "new"))
    design = grid(spark, {"Plot": range(1, 4), "Year": [2022, 2023, 2024]})
    counts = panel.cohort_counts_complete(members, design, "seedling")
    assert rows(counts) == [(1, 2022, 2), (1, 2023, 1), (1, 2024, 0), (2, 2022, 0), (2, 2023, 1),
                            (2, 2024, 0), (3, 2022, 0), (3, 2023, 1), (3, 2024, 1)]
    out = panel.cohort_summary(counts, ["Year"])
    assert out.columns == ["Year", "Mean_Count", "SE"]


@pytest.fixture(scope="module")
def roster_panel(spark):
    return spark.createDataFrame([
        (1, "1", "A", "seedling", 2022, "alive", None, "no"),
        (1, "1", "A", "seedling", 2022, "alive", None, "yes"),     # repeated roster row
        (1, "1", "A", "seedling", 2023, "dead", None, "no"),
        (1, "1", "A", "seedling", 2023, "alive", None, "no"),      # any alive wins
        (1, "2", "A", "seedling", 2022, None, None, "no"),
        (1, "2", "A", "seedling", 2023, "dead", None, "no"),
        (1, "2", "A", "seedling", 2023, None, None, "no"),         # no alive, one unknown
        (2, "3", "A", "seedling", 2022, "alive", None, "no"),
        (2, "3", "A", "seedling", 2024, "dead", None, "no"),
        (9, "9", "A", "resprout", 2022, "alive", None, "no"),
    ], SCHEMA)


def test_survival_history_and_rates(roster_panel, rows):
    history = panel.survival_history(roster_panel, 2022, [2023, 2024], "seedling")
    assert rows(history) == [
        (1, "1", "alive", "alive", None), (1, "1", "alive", "alive", None),
        (1, "2", None, None, None), (2, "3", "alive", None, "dead")]
    assert rows(panel.survival_rates(history, 2022, [2023, 2024])) == [(4, 2, 0.5, 0, 0.0)]
    filled = panel.survival_history(roster_panel, 2022, [2023, 2024], "seedling", fill="dead")
    assert (1, "2", None, "dead", "dead") in rows(filled)


def test_transitions_and_summaries(roster_panel, rows):
    history = panel.survival_history(roster_panel, 2022, [2023, 2024], "seedling",
                                     carry=["Exclosure"], fill="dead")
    moves = panel.transitions(history, [2023, 2024], [])
    assert rows(moves) == [(1, "1", 2023, 1.0), (1, "1", 2024, 0.0), (1, "2", 2023, 0.0),
                           (1, "2", 2024, 0.0), (2, "3", 2023, 0.0), (2, "3", 2024, 0.0)]
    assert rows(panel.survival_summary(moves, ["Plot", "Year"])) == [
        (1, 2023, 2, 1.0, 0.5), (1, 2024, 2, 0.0, 0.0), (2, 2023, 1, 0.0, 0.0), (2, 2024, 1, 0.0, 0.0)]
    by_plot = rows(panel.survival_by(history, ["Plot", "Exclosure"]))
    assert (1, "no", 2022, 2, None, None) in by_plot      # unknown base status
    assert (1, "yes", 2023, 1, 1, 1.0) in by_plot


def test_establishment_density(spark, rebuilt, rows):
    design = grid(spark, {"Plot": range(1, 4), "Year": [2023, 2024], "Exclosure": ["no", "yes"]})
    cover = spark.createDataFrame([(1, 2023, "no", 0.0), (1, 2023, "yes", 1.0)],
                                  "Plot int, Year int, Exclosure string, cover double")
    out = panel.establishment(rebuilt, design, cover, 2022, "Exclosure", {"yes": 0.5}, 9.0,
                              "cover", [])
    found = {(r["Plot"], r["Year"], r["Exclosure"]): r for r in out.collect()}
    assert len(found) == 12
    assert found[1, 2023, "no"]["total_seedlings"] == 2 and found[1, 2023, "no"]["log_cover"] == 0.0
    assert found[1, 2023, "yes"]["density"] == pytest.approx(2.0)
    assert found[3, 2023, "yes"]["density"] == 0.0 and found[3, 2023, "yes"]["log_cover"] is None
