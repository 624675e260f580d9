"""Every core query with SQL gives that SQL's rows; those without run."""

import pytest

from footgrid.plans import catalogue
from tests.compare import query_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, tiny, name):
    assert query_rows(catalogue.queries()[name](spark, tiny)) == sql_rows(catalogue.oracle_sql()[name], tiny)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, tiny, name):
    assert catalogue.queries()[name](spark, tiny).collect() is not None


def test_sql_belongs_to_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
