"""Every catalogue query with SQL returns the rows of its SQL on the smallest tables."""

from __future__ import annotations

import compare
import pytest

from windlass.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.views(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    said = compare.compare(spark, con, name, catalogue.queries()[name], catalogue.oracle_sql()[name], SF)
    assert ": same " in said, said


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) == {"bucket", "n"}
    assert set(e.oracle_sql()) <= set(e.queries())
