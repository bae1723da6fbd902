"""Every query with a DuckDB equivalent gives its rows."""

import pytest

from starfield import catalog
from tests.oracle import both


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    ours, theirs = both(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)
    assert len(ours) == len(theirs)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
