"""Every query against its SQL on the smallest tables."""

import pytest

from comparing import numbers, rows_of, rows_of_sql
from rasterloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        assert numbers(rows_of(df)) == numbers(rows_of_sql(oracle, catalog.ORACLES[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
