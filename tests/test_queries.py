"""Every registered query against its SQL, on the smallest tables; no plan pairs all with all."""

import contextlib
import io

import __spark_entry__ as registry
import pytest
from compare import database, difference, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES = registry.catalog.registered()
ORACLES = registry.oracles.statements()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert difference(spark_rows(df), sql_rows(con, ORACLES[name])) == ""
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        df.explain()
    assert "CartesianProduct" not in plan.getvalue()
    assert "BroadcastNestedLoopJoin" not in plan.getvalue()


def test_entry(spark):
    rows = registry.entry(spark)
    assert rows.count() > 0
    assert rows.columns == [
        "applicant_id",
        "job_id",
        "n_required",
        "n_matched",
        "n_missing",
        "coverage",
    ]
