"""Every registered query of the engine runs; those with SQL give the same rows in DuckDB."""

import pytest
from conftest import rows_of

from brindle import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf, duck):
    got = registry.queries()[name](spark, sf)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.toPandas()
    if (sql := registry.oracle_sql().get(name)) is not None:
        want = duck.execute(sql).df()
        assert sorted(rows.columns) == sorted(want.columns)
        assert rows_of(rows) == rows_of(want)
