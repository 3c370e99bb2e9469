import datetime as dt

import pytest
from pyspark.sql import functions as F

from plotfield.functions import (
    any3, as_date, band, cols_with_prefix, count_distinct_with_missing, density, interaction_key,
    is_in, label_pairs, level_rank, levels, lookup, mean_sd_text, non_numeric, not_in,
    overwrite_when, parity, parse_subplot, paste, recode, remove_first, season, std_error, strict,
    to_number, underscores_to_spaces, water_year, with_error_bounds, with_levels,
)


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(
        [(1, "new", "alive"), (2, None, "dead"), (3, "big", None), (4, "new_large", "alive")],
        "id int, note string, status string")


def test_missing_is_not_a_member_and_is_kept_by_not_in(notes, rows):
    assert rows(notes.where(not_in("note", ["new", "new_large"])), "id") == [(2,), (3,)]
    assert rows(notes.where(is_in("note", ["new", "new_large"])), "id") == [(1,), (4,)]


def test_any3_three_values(spark, rows):
    df = spark.createDataFrame(
        [("t", True), ("t", None), ("u", False), ("u", None), ("f", False), ("n", None)],
        "g string, c boolean")
    out = dict(rows(df.groupBy("g").agg(any3(F.col("c")).alias("a"))))
    assert out == {"t": True, "u": None, "f": False, "n": None}


def test_strict_and_standard_errors(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None), ("b", 3.0)],
                               "g string, v double")
    out = {r["g"]: r for r in df.groupBy("g").agg(
        strict(F.avg("v"), "v").alias("m"), std_error("v").alias("rows"),
        std_error("v", "nonnull").alias("seen"), count_distinct_with_missing("v").alias("d"),
    ).collect()}
    assert out["a"]["m"] == 2.0 and out["b"]["m"] is None
    assert out["b"]["rows"] == pytest.approx(2**0.5 / 3**0.5)
    assert out["b"]["seen"] == pytest.approx(1.0)
    assert (out["a"]["d"], out["b"]["d"]) == (2, 3)
    with pytest.raises(ValueError):
        std_error("v", "other")


def test_recode_keeps_or_defaults(notes, rows):
    kept = notes.select("id", recode("note", {"new": "N"}).alias("x"))
    assert rows(kept) == [(1, "N"), (2, None), (3, "big"), (4, "new_large")]
    dropped = notes.select("id", recode("note", {"new": "N"}, default=None).alias("x"))
    assert rows(dropped) == [(1, "N"), (2, None), (3, None), (4, None)]


def test_band_and_parity(spark, rows):
    df = spark.createDataFrame([(1,), (12,), (13,), (36,), (37,), (None,)], "p int")
    bands = [(1, 12, "a"), (13, 24, "b"), (25, 36, "c")]
    out = rows(df.select("p", band("p", bands).alias("x"), parity("p", "odd", "even").alias("y")))
    assert out == [(1, "a", "odd"), (12, "a", "even"), (13, "b", "odd"), (36, "c", "even"),
                   (37, None, "odd"), (None, None, None)]


def test_pairs_lookup_and_overwrite(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x")], "f string, s string")
    assert rows(df.select(label_pairs("f", "s", {("a", "x"): "AX"}).alias("l"))) == [
        ("AX",), (None,), (None,)]
    assert rows(df.select(lookup("f", {"a": 7}).alias("l"))) == [(7,), (7,), (None,)]
    out = overwrite_when(df, "s", F.col("f") == "a", "z")
    assert rows(out) == [("a", "z"), ("a", "z"), (None, None)]


def test_levels(spark, rows):
    df = spark.createDataFrame([("lo",), ("hi",), ("odd",), (None,)], "l string")
    declared = with_levels(df, "l", ["lo", "hi"])
    assert rows(declared) == [("hi",), ("lo",), (None,), (None,)]
    assert declared.schema["l"].metadata == {"levels": ["lo", "hi"]}
    assert rows(df.select("l", level_rank("l", ["lo", "hi"]).alias("r"))) == [
        ("hi", 2), ("lo", 1), ("odd", None), (None, None)]
    assert [r[0] for r in levels(df, "l").collect()] == ["hi", "lo", "odd"]


def test_number_probe_and_tolerant_cast(spark, rows):
    df = spark.createDataFrame([("1.5",), ("-2",), ("#DIV/0!",), ("?",), (None,), ("",)], "v string")
    assert rows(non_numeric(df, "v")) == [("#DIV/0!",), ("?",)]
    assert rows(df.select(to_number("v").alias("n"))) == [(-2.0,), (1.5,)] + [(None,)] * 4


def test_text(spark, rows):
    df = spark.createDataFrame([("a", "b", 1.0), ("a", None, None)], "x string, y string, z double")
    assert rows(df.select(paste("x", "y", sep="_").alias("p"))) == [("a_NA",), ("a_b",)]
    assert rows(df.select(interaction_key("x", "y").alias("k"))) == [("a.b",), (None,)]
    assert rows(df.select(mean_sd_text("z", "z").alias("t"))) == [("1.00 ± 1.00",), ("NA ± NA",)]
    words = spark.createDataFrame([("a_b_c",), ("plain",)], "w string")
    assert rows(words.select(underscores_to_spaces("w").alias("w"))) == [("a b c",), ("plain",)]
    assert rows(words.select(remove_first("w", "_").alias("w"))) == [("ab_c",), ("plain",)]


def test_subplot_codes(spark, rows):
    df = spark.createDataFrame([("12O",), ("3E",), ("7H",), ("x",)], "Plot string")
    out = parse_subplot(df, "Plot", "OE", "E", "in", "out")
    assert rows(out, "Plot", "Exclosure") == [(12, "out"), (3, "in"), (None, "out"), (None, "out")]
    tail = parse_subplot(df, "Plot", "H", "H", "yes", "no", anchored=True)
    assert (7, "yes") in rows(tail, "Plot", "Exclosure")


def test_dates(spark, rows):
    days = ["2022-03-31", "2022-04-01", "2022-09-30", "2022-10-01", "2023-04-30", "2023-05-01",
            "2024-04-29", "2024-04-30"]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(d + "T13:00:00"),) for d in days],
                               "t timestamp")
    ranges = [("2022-04-01", "2023-05-01", "one"), ("2023-05-01", "2024-04-30", "two")]
    out = [tuple(r) for r in df.select(
        as_date("t").cast("string"), water_year("t"), season("t", ranges)).collect()]
    assert [o[0] for o in out] == days
    assert [o[1] for o in out] == [2022, 2022, 2022, 2023, 2023, 2023, 2024, 2024]
    assert [o[2] for o in out] == [None, "one", "one", "one", "one", "two", "two", None]


def test_density_bounds_and_prefixes(spark, rows):
    df = spark.createDataFrame([(9, "no", 2.0), (2, "yes", 1.0)], "n int, e string, se double")
    assert rows(df.select(density("n", "e", {"yes": 0.5}, 9.0).alias("d"))) == [(1.0,), (4.0,)]
    bounds = with_error_bounds(df, "n", "se")
    assert rows(bounds, "lower", "upper") == [(1.0, 3.0), (7.0, 11.0)]
    assert cols_with_prefix(bounds, "lo", "se") == ["se", "lower"]
