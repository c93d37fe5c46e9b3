from __future__ import annotations

import pytest

from millrace.llm import queries

from ..oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    same(spark, small, queries.QUERIES[name], queries.ORACLES[name])
