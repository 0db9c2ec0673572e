"""Every catalogue query against its SQL on the smallest tables."""

import pytest

from quirework.plans import catalog

from .conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, same, name):
    same(catalog.QUERIES[name](spark, SF), duck.sql(catalog.SQL[name]))
