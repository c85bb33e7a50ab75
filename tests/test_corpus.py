"""Every query with SQL for another engine gives that engine's rows."""

from __future__ import annotations

import pytest
from compare import duck, rows

from tidemark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    mine = QUERIES[name](spark, sf).toPandas()
    theirs = con.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
