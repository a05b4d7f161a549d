"""Every query runs on the smallest data, and equals its SQL twin where it has one."""

import pytest

from tessera.llm import queries as q
from tests.oracle import DATA, connect, rows


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, name):
    got = q.QUERIES[name](spark, str(DATA)).toPandas()
    if name in q.ORACLE:
        want = connect().execute(q.ORACLE[name]).df()
        assert rows(got) == rows(want)
