"""Every core query runs on the smallest data and equals its SQL twin."""

import pytest

from tessera import queries_core
from tessera.catalog import graph, knowledge, memory, search, upkeep
from tests.oracle import DATA, connect, rows

MODULES = [queries_core, search, knowledge, memory, graph, upkeep]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    if name in ORACLE:
        want = connect().execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
