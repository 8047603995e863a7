"""Every query of the library runs, and equals its SQL twin where it has one."""

import os

import pytest

from dossier.plans import registry
from tests.sql_twin import DATA, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        same(df, SQL[name])
    else:
        assert len(df.columns) > 0 and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
