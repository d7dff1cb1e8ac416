"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from tests.checks import DATA, connect, differences, spark_rows, sql_rows

QUERIES, ORACLES = entry.QUERIES, entry.oracle_sql()
FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect("0.001")


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    nested = [line for line in plan.splitlines() if "BroadcastNestedLoopJoin" in line]
    assert not nested
    # A window over everything would sort the whole table in one task.
    assert not re.search(r"Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan)
    assert "PythonUDF" not in plan and "ArrowEval" not in plan and "PythonMap" not in plan
    rows = spark_rows(df)
    assert rows[1], "no rows"
    assert differences(rows, sql_rows(duck, ORACLES[name])) == []


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() == 1500
    assert {"counted_total", "effective_qty", "tonnage"} <= set(df.columns)


def test_scans_read_only_needed_columns(spark):
    df = QUERIES["pr_11"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"o_orderkey", "o_orderstatus", "o_orderdate"}
