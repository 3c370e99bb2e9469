import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotfield.operators import (
    add_baseline, anti_join, arrange, box_outliers, box_stats, complete, contingency,
    duplicate_keys, earliest_rows, exact_quantiles, first_rows, first_seen, grid, grid_over,
    inner_join, keep_groups_any, left_join, longer, longer_values, lookup_join, mean_sd_table,
    mean_se, member_flag, null_count, pool_se, proportion_se, rates, semi_join, separate,
    summarise_across, union_fill, union_strict, var_table, wider, with_position, zscore,
)


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (3, "b")], "k int, s string")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(None, 10), ("b", 20), ("b", 21)], "s string, w int")


def test_joins_match_missing_with_missing(left, right, rows):
    assert rows(inner_join(left, right, "s")) == [
        (2, None, 10), (3, "b", 20), (3, "b", 20), (3, "b", 21), (3, "b", 21)]
    assert (1, "a", None) in rows(left_join(left, right, "s"))
    assert rows(semi_join(left, right, "s")) == [(2, None), (3, "b"), (3, "b")]
    assert rows(anti_join(left, right, "s")) == [(1, "a")]
    assert rows(member_flag(left, right, "s", "f")) == [
        (1, "a", False), (2, None, True), (3, "b", True), (3, "b", True)]


def test_join_on_renamed_keys_and_clashing_columns(left, right, rows):
    other = right.withColumnsRenamed({"s": "code", "w": "k"})
    out = inner_join(left, other, [("s", "code")], suffixes=("_x", "_y"))
    assert out.columns == ["k_x", "s", "k_y"] and (2, None, 10) in rows(out)
    with pytest.raises(ValueError, match="both sides"):
        inner_join(left, other, [("s", "code")])
    looked = lookup_join(left, [("a", 1.0), (None, 9.0)], "s string, area double", "s")
    assert rows(looked, "k", "area") == [(1, 1.0), (2, 9.0), (3, None), (3, None)]


def test_grid_and_complete(spark, rows):
    design = grid(spark, {"p": range(1, 4), "y": [7, 8]})
    assert design.count() == 6 and design.schema["p"].dataType.simpleString() == "int"
    facts = spark.createDataFrame([(1, 7, 5), (9, 7, 1)], "p int, y int, n int")
    assert rows(complete(design.withColumn("n", F.lit(0)), facts, ["p", "y"])) == [
        (1, 7, 5), (1, 8, 0), (2, 7, 0), (2, 8, 0), (3, 7, 0), (3, 8, 0)]
    assert grid_over(facts, {"e": ["no", "yes"]}).count() == 4
    assert grid_over(facts, {"e": list(range(12_001))}).count() == 24_002


def test_unions(spark, left, right, rows):
    assert rows(union_fill(left, right)) == [
        (1, "a", None), (2, None, None), (3, "b", None), (3, "b", None),
        (None, "b", 20), (None, "b", 21), (None, None, 10)]
    with pytest.raises(ValueError, match="column sets differ"):
        union_strict(left, right)
    assert union_strict(left, left.select("s", "k")).count() == 8
    out = add_baseline(left, [("z", 9)], ["s", "k"])
    assert (9, "z") in rows(out) and out.schema["k"].dataType.simpleString() == "int"


def test_order(left):
    assert [r["s"] for r in arrange(left, "s").collect()] == ["a", "b", "b", None]
    assert [r["k"] for r in first_rows(left, 2, ["k"]).collect()] == [1, 2]


def test_longer_forms(spark, rows):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id int, cover_2020 double, cover_2021 double, area_2020 double")
    assert rows(longer(df, cols=["cover_2020"]).select("id", "name", "value")) == [(1, "cover_2020", 2.0)]
    assert longer(df, ids=["id"]).count() == 3
    assert longer(df, prefix="cover").count() == 2
    out = longer(df, ids=["id"], names_pattern="(.*)_(.*)", names_to=["m", "y"])
    assert rows(out) == [(1, "area", "2020", 4.0), (1, "cover", "2020", 2.0), (1, "cover", "2021", 3.0)]
    with pytest.raises(ValueError):
        longer(df)


def test_longer_keeps_missing_values_and_mixed_types(spark, rows):
    df = spark.createDataFrame([(1, None, "x")], "id int, a double, b string")
    assert rows(longer(df, ids=["id"], value_type="string")) == [(1, "a", None), (1, "b", "x")]


def test_longer_values_splits_at_last_separator(spark, rows):
    df = spark.createDataFrame([("g", 1.0, 2.0, 3.0)], "g string, a_b_mean double, a_b_sd double, c_mean double")
    assert rows(longer_values(df, ["g"])) == [("g", "a_b", 1.0, 2.0), ("g", "c", 3.0, None)]
    with pytest.raises(ValueError):
        longer_values(df.withColumn("bad", F.lit(1.0)), ["g"])


def test_separate_fills_absent_pieces(spark, rows):
    df = spark.createDataFrame([("VWC_1_a",), ("VWC_2",), (None,)], "c string")
    assert rows(separate(df, "c", [None, "p", "d"], "_")) == [("1", "a"), ("2", None), (None, None)]


def test_positions_over_several_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 100).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("s"), F.col("id").alias("i")).repartition(5)
    wanted = sorted(((r.k, r.s is None, r.s or 0, r.i) for r in df.collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_position(df, "k", "s", "i")
        assert out.columns == ["k", "s", "i", "position"]
        found = sorted(out.collect(), key=lambda r: r.position)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.position for r in found] == list(range(1, 1001))
    assert [(r.k, r.s is None, r.s or 0, r.i) for r in found] == wanted
    tied = with_position(df.select(F.lit(1).alias("k")), "k", name="n")
    assert sorted(r.n for r in tied.collect()) == list(range(1, 1001))
    assert with_position(df.where("k < 0"), "k").count() == 0


def test_wider(spark, rows):
    df = spark.createDataFrame(
        [(1, 2023, "alive"), (1, 2024, "dead"), (2, 2023, None), (3, None, "x")],
        "t int, y int, s string")
    for values in ([2023, 2024, None], None):
        out = wider(df, ["t"], "y", "s", values, prefix="S_")
        assert out.columns == ["t", "S_2023", "S_2024", "S_NA"]
        assert rows(out) == [(1, "alive", "dead", None), (2, None, None, None), (3, None, None, "x")]
    named = wider(df.where("y is not null"), ["t"], "y", "s", prefix="S_")
    assert named.columns == ["t", "S_2023", "S_2024"]
    assert rows(named) == [(1, "alive", "dead"), (2, None, None)]
    with pytest.raises(Exception, match="not listed: 2024"):
        wider(df, ["t"], "y", "s", [2023, None]).collect()
    with pytest.raises(Exception, match="not listed: missing"):
        wider(df, ["t"], "y", "s", [2023, 2024]).collect()
    twice = df.union(spark.createDataFrame([(1, 2023, "dead")], df.schema))
    with pytest.raises(Exception, match="several values"):
        wider(twice, ["t"], "y", "s", [2023, 2024, None]).collect()
    unnamed = df.union(spark.createDataFrame([(3, None, "y")], df.schema))
    with pytest.raises(Exception, match="several values"):
        wider(unnamed, ["t"], "y", "s").collect()
    texts = spark.createDataFrame([(1, "NA", 1.0), (1, None, 2.0)], "t int, y string, v double")
    with pytest.raises(ValueError, match="'NA'"):
        wider(texts, ["t"], "y", "v")


@pytest.fixture(scope="module")
def measured(spark):
    return spark.createDataFrame(
        [("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, None), ("b", 1, 4.0), ("b", 2, 6.0), ("c", 1, None)],
        "g string, y int, v double")


def test_mean_se_variants(measured):
    out = {r["g"]: r for r in mean_se(measured, ["g"], "v").collect()}
    assert out["a"]["mean"] == 1.5 and out["a"]["n"] == 3
    assert out["a"]["se"] == pytest.approx(0.5**0.5 / 3**0.5)
    assert out["c"]["mean"] is None and out["c"]["sd"] is None
    seen = {r["g"]: r for r in mean_se(measured, ["g"], "v", n="nonnull").collect()}
    assert seen["a"]["se"] == pytest.approx(0.5)
    tight = {r["g"]: r for r in mean_se(measured, ["g"], "v", strict=True).collect()}
    assert tight["a"]["mean"] is None and tight["b"]["mean"] == 5.0


def test_pooled_error_and_counts(spark, measured, rows):
    df = spark.createDataFrame([("x", 1.0, 3.0), ("x", 3.0, 4.0)], "g string, m double, e double")
    assert rows(pool_se(df, ["g"], "m", "e")) == [("x", 2.0, 2.5)]
    assert rows(duplicate_keys(measured, ["g", "y"])) == [("a", 1, 2)]
    assert rows(null_count(measured, "v", "g")) == [(2, 0)]
    out = rows(rates(measured, [], {"big": F.col("v") > 1.5}))
    assert out == [(6, 3, 0.5)]
    crossed = rows(contingency(measured, ["g", "y"]))
    assert crossed == [("a", 1, 2), ("a", 2, 1), ("b", 1, 1), ("b", 2, 1), ("c", 1, 1), ("c", 2, 0)]


def test_across_tables(measured, rows):
    out = summarise_across(measured, ["g"], ["v", "y"], ["mean", "max"])
    assert out.columns == ["g", "v_mean", "v_max", "y_mean", "y_max"]
    texts = dict(((r["g"], r["variable"]), r["mean_sd"])
                 for r in mean_sd_table(measured, ["g"], ["v"]).collect())
    assert texts["b", "v"] == "5.00 ± 1.41" and texts["c", "v"] == "NA ± NA"
    assert rows(var_table(measured, ["v"])) == [("v", 4.0, 2.0, 3.25, pytest.approx(4.916666666))]


def test_proportion_uses_fixed_cohort(spark):
    df = spark.createDataFrame(
        [("b", 1, "t1", 1), ("b", 1, "t2", 1), ("b", 2, "t1", 1), ("b", 2, "t2", 0), ("b", 2, "t1", 1)],
        "g string, y int, tag string, s int")
    out = {r["y"]: r for r in proportion_se(df, ["g", "y"], "tag", F.col("s") == 1, ["g"],
                                            cohort=F.col("y") == 1).collect()}
    assert (out[2]["survived"], out[2]["n_cohort"], out[2]["proportion"]) == (1, 2, 0.5)
    assert out[2]["se"] == pytest.approx((0.25 / 2) ** 0.5) and out[1]["se"] == 0.0


def test_zscore(spark):
    values = np.array([1.0, 2.0, 4.0, 9.0])
    df = spark.createDataFrame([(float(v), 5.0) for v in values], "v double, c double")
    out = zscore(df, ["v", "c"]).toPandas()
    assert np.allclose(sorted(out["v"]), (values - values.mean()) / values.std(ddof=1))
    assert out["c"].isna().all()


def test_group_operators(spark, rows):
    df = spark.createDataFrame(
        [("p", "t", 2023, "x"), ("p", "t", 2023, "x"), ("p", "t", 2024, "y"), ("p", None, 2024, "z"),
         ("q", "t", None, "w"), ("q", "t", 2022, "v")], "p string, t string, y int, s string")
    seen = first_seen(df, ["p", "t"], "y")
    assert rows(seen, "p", "t", "y", "FirstYear") == [
        ("p", "t", 2023, 2023), ("p", "t", 2023, 2023), ("p", "t", 2024, 2023),
        ("p", None, 2024, 2024), ("q", "t", 2022, 2022), ("q", "t", None, 2022)]
    assert rows(earliest_rows(df, ["p", "t"], "y")) == [
        ("p", "t", 2023, "x"), ("p", None, 2024, "z")]
    assert rows(keep_groups_any(df, ["p", "t"], F.col("s") == "y"), "y") == [(2023,), (2023,), (2024,)]


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_quantiles_match_brute_force(spark, partitions):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({
        "g": ["hot"] * 30_000 + ["warm"] * 40 + ["one"] + ["tied"] * 500,
        "v": np.concatenate([rng.lognormal(size=30_000), rng.normal(size=41),
                             rng.integers(0, 3, 500).astype(float)])})
    df = spark.createDataFrame(pdf).repartition(partitions)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    out = exact_quantiles(df, ["g"], "v", probs).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert out.loc[g, "n"] == len(part)
        assert np.allclose(out.loc[g, [f"q{i}" for i in range(5)]].astype(float),
                           np.quantile(part["v"], probs), rtol=1e-12)
    whole = exact_quantiles(df, [], "v", [0.5]).toPandas()
    assert whole["q0"][0] == pytest.approx(pdf["v"].median(), rel=1e-12)


def test_box_summary_and_outliers(spark, rows):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", None)],
                               "g string, v double")
    row = box_stats(df, ["g"], "v").collect()
    assert [tuple(r) for r in row] == [("a", 1.0, 2.0, 3.0, 4.0, 4.0, 5, 1)]
    assert rows(box_outliers(df, ["g"], "v")) == [("a", 100.0)]
    assert rows(box_outliers(df, [], "v")) == [(100.0,)]


def test_missing_units_are_one_unit(spark, rows):
    df = spark.createDataFrame([("g", None, True), ("g", "a", True), ("g", "b", False), ("h", "a", True), ("h", None, None)],
                               "g string, tag string, alive boolean")
    out = proportion_se(df, ["g"], "tag", F.col("alive"), ["g"])
    assert rows(out, "g", "survived", "n_cohort") == [("g", 2, 3), ("h", 1, 2)]


def test_not_a_number_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    assert exact_quantiles(df, [], "v", [0.5]).first()["q0"] == 2.0
    found = mean_se(df, [], "v").first()
    assert (found["mean"], found["sd"]) == (2.0, pytest.approx(2**0.5))


@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_of_hot_groups_and_odd_values(spark, by):
    import numpy as np

    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 3000), rng.normal(0, 1e6, 500).round(), [1e308, -1e308, 5e-324, 0.0, -0.0], np.full(700, 2.5)])
    groups = np.where(np.arange(len(values)) % 100 == 0, "cold", "hot")
    df = spark.createDataFrame(list(zip(groups.tolist(), values.tolist())), "g string, v double").repartition(5)
    probs = [0, 0.013, 0.25, 0.5, 0.999, 1]
    out = exact_quantiles(df, by, "v", probs)
    for row in out.collect():
        part = values[groups == row["g"]] if by else values
        found = [row[f"q{i}"] for i in range(len(probs))]
        assert np.allclose(found, np.quantile(part, probs), rtol=1e-12)
    assert exact_quantiles(df.limit(0), by, "v", [0.5]).count() == 0


def test_measures_keep_their_type(spark):
    from plotfield.operators import longer_values
    df = spark.createDataFrame([("k", "x", 2**60 + 1, "y", 7)], "id string, a_text string, a_big long, b_text string, b_big long")
    out = longer_values(df, ["id"])
    assert {(r["variable"], r["text"], r["big"]) for r in out.collect()} == {("a", "x", 2**60 + 1), ("b", "y", 7)}


def test_quantiles_read_their_source_twice(spark, tmp_path):
    """Hot groups of ties and continuous values; the rows that the source hands out are counted."""
    rng = np.random.default_rng(8)
    n = 60_000
    values = np.where(rng.random(n) < 0.3, rng.integers(0, 4, n), rng.lognormal(0, 3, n))
    groups = np.where(rng.random(n) < 0.6, "hot", np.where(rng.random(n) < 0.5, "warm", None))
    pdf = pd.DataFrame({"g": groups, "v": values})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "t"))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.read.parquet(str(tmp_path / "t")).mapInArrow(counted, "g string, v double")
    out = box_stats(df, ["g"], "v").collect()
    assert read.value == 2 * n
    for r in out:
        part = pdf.v[pdf.g.isna() if r["g"] is None else pdf.g == r["g"]]
        q1, med, q3 = np.quantile(part, [0.25, 0.5, 0.75])
        inside = part[(part >= q1 - 1.5 * (q3 - q1)) & (part <= q3 + 1.5 * (q3 - q1))]
        assert np.allclose([r["lower"], r["q1"], r["median"], r["q3"], r["upper"]], [min(inside.min(), q1), q1, med, q3, max(inside.max(), q3)], rtol=1e-12)
        assert (r["n"], r["n_outliers"]) == (len(part), len(part) - len(inside))


def test_quantiles_outside_of_their_brackets(spark, monkeypatch):
    """Brackets far too narrow for their sketch are noticed and widened."""
    from plotfield.operators import quantiles
    monkeypatch.setattr(quantiles, "SKETCH", 8)
    monkeypatch.setattr(quantiles, "MARGINS", (1e-6, 0.01, 1.0))
    values = np.random.default_rng(4).normal(size=20_000)
    out = exact_quantiles(spark.createDataFrame(pd.DataFrame({"v": values})).repartition(5), [], "v", [0.1, 0.77]).first()
    assert np.allclose([out["q0"], out["q1"]], np.quantile(values, [0.1, 0.77]), rtol=1e-12)
