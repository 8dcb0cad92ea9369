import pytest

from tallymart import plans

QUERIES, ORACLES = plans.queries(), plans.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, sf_dir, same):
    same(QUERIES[name](spark, sf_dir), ORACLES[name])


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
