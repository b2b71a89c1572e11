import pytest
from duck import duck_rows, rows_of

from freshet import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == duck_rows(queries.ORACLE_SQL[name], SF)
