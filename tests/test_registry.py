"""Every registered query against the same question in DuckDB, on the smallest given tables."""

from __future__ import annotations

import os

import pytest
from compare import duckdb_over, duckdb_rows, spark_rows

from tallyloom.registry import all_oracle_sql, all_queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are missing")


@pytest.fixture(scope="module")
def connection():
    return duckdb_over(FOLDER)


def test_every_query_has_its_sql():
    assert set(all_queries()) == set(all_oracle_sql())


# Queries on a batch of requests, each of which depends on those before it.
SETTLED_IN_TURN = {
    "schedule_admission_batch",
    "schedule_messages",
    "schedule_recipients",
    "schedule_change_log",
}

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, connection, name):
    result = all_queries()[name](spark, FOLDER)
    sql = all_oracle_sql()[name]

    types = {field.name: TYPES[field.dataType.simpleString()] for field in result.schema}
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    assert types == {row[0]: str(row[1]) for row in described}

    plan = result._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython"):
        assert node not in plan
    if name not in SETTLED_IN_TURN:
        assert "InPandas" not in plan

    columns, rows = spark_rows(result)
    expected_columns, expected_rows = duckdb_rows(connection, sql)
    assert columns == expected_columns
    assert rows == expected_rows


def test_entry_gives_rows(spark):
    import __spark_entry__ as driver

    result = driver.entry(spark)
    assert "monthly_payment_id" in result.columns
    assert not result.isEmpty()
