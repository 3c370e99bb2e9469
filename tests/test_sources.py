import pytest
from pyspark.sql.types import DoubleType, StructField, StructType

from plotfield.sources import literal_table, read_table, read_wide


@pytest.fixture
def sheet(tmp_path):
    path = tmp_path / "sheet one.csv"
    path.write_bytes(
        "﻿plot,\" Drought \",cover ,note\r\n1,Drought ,0.5,x\r\n\r\n2,Ambient,#DIV/0!,NA\r\n"
        "3, Ambient,,\r\n".encode())
    return str(path)


def test_headers_fields_blank_lines_and_markers(spark, sheet, rows):
    df = read_table(spark, sheet, "plot int, Drought string, cover double, note string")
    assert df.columns == ["plot", "Drought", "cover", "note"]
    assert rows(df) == [(1, "Drought", 0.5, "x"), (2, "Ambient", None, None),
                        (3, "Ambient", None, None)]


def test_inferred_types_and_struct_schema(spark, sheet, rows):
    inferred = read_table(spark, sheet)
    assert inferred.schema["plot"].dataType.simpleString() == "int"
    schema = StructType([StructField("cover", DoubleType())])
    assert rows(read_table(spark, sheet, schema)) == [(0.5,), (None,), (None,)]
    with pytest.raises(ValueError, match="columns not in file"):
        read_table(spark, sheet, "absent int")


def test_parquet_and_wide(spark, tmp_path, rows):
    path = str(tmp_path / "wide.parquet")
    spark.createDataFrame([(1, 2.0)], "` UTCdate ` int, VWC_1_a double").write.parquet(path)
    assert read_wide(spark, path).columns == ["UTCdate", "VWC_1_a"]
    assert rows(read_table(spark, path, "VWC_1_a string")) == [("2.0",)]


def test_wide_sheets_read_the_wanted_sensors_alone(spark, tmp_path, rows):
    path = str(tmp_path / "wide.csv")
    (tmp_path / "wide.csv").write_text("day, VWC_1_a ,VWC_1_b,VWC_12,T_1_a,note\n2023-01-01,0.5,NA,x,7,k\n2023-01-02,,2,3,8,\n")
    pattern = r"VWC_(?P<plot>\d+)(_(?P<depth>.+))?"
    every = read_wide(spark, path, "day date", pattern)
    assert every.columns == ["day", "VWC_1_a", "VWC_1_b", "VWC_12"]
    assert [tuple(r)[1:] for r in every.orderBy("day").collect()] == [(0.5, None, None), (None, 2.0, 3.0)]
    shallow = read_wide(spark, path, "day date", pattern, keep=lambda header: header["depth"] == "a")
    plan = shallow._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]
    assert [c.split(":")[0].strip() for c in read.split(",")] == ["day", "VWC_1_a"]
    assert rows(shallow.select("VWC_1_a")) == [(0.5,), (None,)]
    with pytest.raises(ValueError, match="no column"):
        read_wide(spark, path, "day date", r"SAL_.*")
    with pytest.raises(ValueError, match="not in file"):
        read_wide(spark, path, "hour int", pattern)


def test_literal_table_of_any_length(spark, rows):
    assert rows(literal_table(spark, [(1, "a")], "k int, v string")) == [(1, "a")]
    assert literal_table(spark, [(i,) for i in range(10_001)], "k int").count() == 10_001


def test_text_that_is_no_number(spark, rows, tmp_path):
    path = str(tmp_path / "t.csv")
    cells = ["12D", "12f", "1e3", ".5", " 7 ", "NaN", "Infinity", "-2.", "x", "0x1"]
    spark.createDataFrame([(c,) for c in cells], "v string").coalesce(1).write.csv(path, header=True)
    assert [r[0] for r in read_table(spark, path, "v double").collect()] == [None, None, 1000.0, 0.5, 7.0, None, None, -2.0, None, None]
