"""Every registered query against its SQL, and the shape of the plans."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables not mounted")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def plain(pdf):
    def value(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return "missing"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)):
            return repr(float(v) + 0.0)
        return str(v)

    ordered = pdf[sorted(pdf.columns)].astype(object)
    ordered = ordered.where(ordered.notna(), None)
    return sorted(tuple(map(value, row)) for row in ordered.itertuples(index=False, name=None))


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 90


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.QUERIES))
def test_query(spark, database, name):
    found = contract.queries()[name](spark, str(DATA)).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(found)
        return
    wanted = database.execute(sql).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert plain(found) == plain(wanted)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


RELATIONAL = sorted(n for n in contract.QUERIES if contract.QUERIES[n].__module__.rsplit(".", 1)[1]
                    in ("recodes", "relations", "summaries", "histories"))


@pytest.mark.parametrize("name", RELATIONAL)
def test_plans_have_no_products_and_no_python(spark, name):
    plan = plan_of(contract.queries()[name](spark, str(DATA)))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan
    assert ("FileScan csv" if name in ("read_table", "wide_sheet_scan") else "FileScan parquet") in plan


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(contract.queries()["treatment_mean_se"](spark, str(DATA)))
    schema = plan.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_partkey", "l_quantity", "l_linestatus"}


def test_wide_sheets_are_scanned_for_the_means_alone(spark):
    plan = plan_of(contract.queries()["wide_sheet_scan"](spark, str(DATA)))
    assert "N_" not in plan.split("FileScan csv", 1)[1] and "VWC_" in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(contract.queries()["filter_membership"](spark, str(DATA)))
    assert "PushedFilters: [" in plan
