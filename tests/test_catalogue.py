"""Every query of the engine itself against its SQL."""

import pytest
from compare import assert_same

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLES:
        assert_same(df, catalogue.ORACLES[name], SF)
    else:
        assert df.count() > 0


def test_entry_lists_all():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.QUERIES) <= set(e.queries())
