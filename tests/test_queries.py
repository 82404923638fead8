"""Every listed query against its SQL, or at least run."""

from __future__ import annotations

import pytest
from compare import compare

from tideline.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    d = "/root/testdata/sf0.01"
    if name in SQL:
        assert compare(spark, d, QUERIES[name], SQL[name]) == ""
    else:
        assert QUERIES[name](spark, d).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
