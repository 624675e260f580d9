import pytest

from footgrid.llm import queries
from tests.compare import query_rows, sql_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, tiny, name):
    assert query_rows(queries.queries()[name](spark, tiny)) == sql_rows(queries.oracle_sql()[name], tiny)
