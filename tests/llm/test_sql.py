"""Queries of the operators against their SQL."""

from collections import Counter

import pytest

from tests.conftest import SMALL
from tidemark.llm.queries import QUERIES
from tidemark.llm.sql import SQL


@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SMALL), con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    place = [list(want.columns).index(c) for c in order]
    assert Counter(map(tuple, got.select(*order).collect())) == Counter(tuple(r[i] for i in place) for r in want.fetchall())
