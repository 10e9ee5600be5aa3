"""Every catalogue query against its SQL on the smallest tables."""

import pytest

from pressline.plans import catalogue
from tests.conftest import canonical

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = canonical(df.select(*columns).collect())
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == columns
        assert rows == canonical(rel.select(*(f'"{c}"' for c in columns)).fetchall())
    else:
        assert rows


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
