"""Every registered query against its SQL, whole results."""

import pytest
from oracle import difference

from workload import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, folder, db, name):
    result = QUERIES[name](spark, folder)
    if name in SQL:
        assert difference(result, db, SQL[name]) is None
    else:
        assert result.count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
