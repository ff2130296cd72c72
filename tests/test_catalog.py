import pytest

from loomaudit import catalog, derived  # noqa: F401  (derived adds its queries)
from oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, data, name):
    assert_same(catalog.QUERIES[name](spark, data), catalog.ORACLE_SQL[name], data)


def test_entry_returns_rows(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
