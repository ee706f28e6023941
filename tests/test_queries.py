"""Every registered query against its SQL on the smallest tables."""
import pytest

from foliant import catalog
from tests.harness import SF, difference

Q, O = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(O))
def test_same_as_sql(spark, name):
    assert difference(spark, name, Q[name], O[name]) is None


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_runs(spark, name):
    df = Q[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
