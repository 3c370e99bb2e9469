"""The studies end to end, on small invented sheets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotfield import plans
from plotfield.plans.life_history import invasive_cover_long


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(21)


@pytest.fixture(scope="module")
def treatments(spark):
    rows = [(p, "BurnedInvaded" if p <= 12 else "BurnedNative" if p <= 24 else "Unburned",
             "Drought" if p % 2 else "Ambient", e) for p in range(1, 37) for e in "NY"]
    return spark.createDataFrame(rows, "Plot int, BurnTreat string, Drought string, Exclosure string")


@pytest.fixture(scope="module")
def history(spark, rng, treatments):
    rows = []
    for tag in range(150):
        plot = int(rng.integers(1, 25))
        start = int(rng.choice([2022, 2023, 2024], p=[0.7, 0.2, 0.1]))
        fence = "yes" if rng.random() < 0.5 else None
        for year in range(max(start, 2023), 2025):
            alive = rng.random() < 0.6
            note = "new" if year == start else None
            rows.append((plot, year, str(tag), "DW", "seedling", "alive" if alive else "dead", fence, note))
            if not alive:
                break
    shrubs = spark.createDataFrame(
        rows, "Plot int, Year int, Tag string, Species string, Type string, Status string, "
              "Exclosure string, Notes string")
    return plans.reconstruct(shrubs, treatments)


@pytest.fixture(scope="module")
def cover(spark, rng):
    def sheet():
        rows = [(f"{p}{s}", float(rng.integers(0, 90))) for p in range(1, 37) for s in ("", "H")]
        return spark.createDataFrame(rows, "plot string, invasive_cover double")

    return invasive_cover_long([(2023, sheet()), (2024, sheet())]).cache()


def test_reconstruct(history, rows):
    assert history["lookup_duplicates"].count() == 36
    panel = history["panel"]
    assert {r[0] for r in rows(panel.select("Species").distinct())} == {"AG"}
    assert {r[0] for r in rows(panel.select("Year").distinct())} == {2022, 2023, 2024}
    assert panel.where("Exclosure is null").count() == 0


def test_cohorts(history):
    out = plans.cohort_study(history["panel"])
    assert out["counts"].count() == 72
    total = out["counts"].agg(F.sum("Count")).first()[0]
    assert total == out["members"].where("Type = 'seedling'").count() == out["per_plot"].agg(F.sum("n_seedlings")).first()[0]
    assert out["display"].count() == 9
    assert {r["BurnTreat"] for r in out["display"].collect()} == {"Moderate Burn", "Severe Burn", "Unburned"}
    assert [r["term"] for r in out["anova"].collect()][0] == "Year"
    assert out["year_contrasts"].count() == 3


def test_survival(history):
    out = plans.survival_study(history["panel"])
    moves = out["transitions"].toPandas()
    rates = out["rates"].first()
    assert rates["n_2022"] == out["history"].count() and set(moves["Survival"]) == {0.0, 1.0}
    alive = moves[moves["Year"] == 2023]["Survival"].sum()
    assert alive == rates["alive_2023"]
    assert out["display"].count() == 6 and out["anova"].count() == 8


def test_subplot_survival_and_establishment(history, cover):
    out = plans.subplot_survival_study(history["panel"], cover)
    assert out["rows"].where("Year = 2022").count() == 0
    assert out["cells"].agg(F.sum("n")).first()[0] == out["rows"].count()
    assert [r["term"] for r in out["anova"].collect()] == [
        "(Intercept)", "BurnTreat", "Exclosure", "Drought", "Year", "invasive_cover",
        "BurnTreat:Exclosure", "Exclosure:Year"]
    built = plans.establishment_study(history["panel"], cover)
    assert built["density"].count() == 96 and built["anova"].count() == 17
    assert built["summary"].first()["bar_group"] == "Moderate_Burn_no_2023"


def test_burn(spark, rng, rows):
    twigs = spark.createDataFrame(
        [(p, "burneda" if p <= 12 else "burnedb", float(rng.normal(6 if p <= 12 else 11))) for p in range(1, 25)],
        "plot int, treatment string, diameter double")
    out = plans.burn_intensity(twigs)
    assert out["t_test"].first()["t"] < 0 and out["box"].count() == 2
    terrain = spark.createDataFrame([(p, float(p)) for p in range(1, 37)], "plot int, slope double")
    line = plans.diameter_against(twigs, terrain, "slope")
    assert line["joined"].count() == 24 and line["band"].count() == 80
    assert line["regression"].first()["slope"] > 0


def test_cover(spark, rng, treatments):
    wide = pd.DataFrame({"plot": range(1, 37)})
    for year in (2020, 2021):
        wide[f"evergreen_cover_{year}"] = rng.random(36)
        wide[f"plot_area_{year}"] = 9.0
        wide[f"percent_cover_{year}"] = 100 * wide[f"evergreen_cover_{year}"] / 9
    out = plans.cover_study(spark.createDataFrame(wide), treatments)
    assert out["long"].count() == 72 and out["summary"].count() == 12 and out["pooled"].count() == 6
    assert out["contrasts"].count() == 15
    assert out["summary"].where("TreatmentLabel is null").count() == 0


def test_biomass(spark, rng):
    later = spark.createDataFrame(
        [(p, float(rng.gamma(2)), float(rng.gamma(2))) for p in range(1, 37)],
        "`Plot #` int, Enclosed double, `Not Enclosed` double")
    earlier = spark.createDataFrame(
        [(f"{p}{s}", float(rng.gamma(2))) for p in range(1, 37) for s in "OE"], "Plot string, Live double")
    out = plans.biomass_study(later, earlier)
    assert out["long"].count() == 144 and out["summary"].count() == 12
    assert out["tukey_2023"].count() == 3 and out["mixed_anova"].count() == 16
    assert out["three_way"].frame.n == 144 and out["three_way"].n_groups == 36
    assert out["mixed_contrasts"].count() == 24 * 23 // 2


def test_moisture(spark):
    names = [f"VWC_{p}{d}" for p in range(1, 37) for d in ("", "_a")]
    sheet = spark.range(0, 24).select(
        F.expr("timestamp'2022-09-01 10:00:00' + make_interval(0, cast(id as int))").alias("UTCdate"),
        *[(F.rand(i) + i % 5).alias(n) for i, n in enumerate(names)])
    out = plans.moisture_study(sheet)
    assert out["long"].count() == 24 * 72
    assert {r["Depth"] for r in out["daily"].collect()} == {"a", "profile"}
    assert {r["Water_Year"] for r in out["seasonal"].collect()} == {"2022-2023", "2023-2024"}
    assert out["plot_means"].count() == 24 * 36 and out["anova"].count() == 9
    assert out["box_profiles"].agg(F.sum("n")).first()[0] == 24 * 36
    assert out["box_plot_means"].count() == out["box_readings"].count() == 18


def test_severity_paths(spark, rng):
    pdf = pd.DataFrame({"plot": range(1, 37), "twig_dm": rng.normal(8, 3, 36)})
    for c in ("invasive_cover", "total_cover", "relative_invasive", "2022_survival"):
        pdf[c] = rng.random(36) * 10
    pdf["n_seedlings_total"] = rng.integers(0, 30, 36)
    out = plans.severity_study(spark.createDataFrame(pdf))
    assert out["summary"].count() == 18 and out["publication_table"].count() == 14
    fire = {r["variable"]: r for r in out["variables"].collect()}["fire_severity"]
    assert fire["mean"] == pytest.approx(0.0, abs=1e-12) and fire["variance"] == pytest.approx(1.0)
    assert out["full_fit"].first()["df"] == 0 and out["reduced_fit"].first()["df"] == 1
    s = 23 / 24
    assert out["reduced_fit"].first()["chisq"] == pytest.approx(24 * (s - np.log(s) - 1), rel=1e-8)
    assert out["full_effects"].count() == 6 and out["reduced_effects"].count() == 4
