"""Every core query against its SQL twin; those without one must run."""

import pytest

from lexloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark, data):
    """Every column is computed; what it holds is tested against plain Python in the other modules."""
    registry.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
