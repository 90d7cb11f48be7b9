"""Every query of the corpus operators that has SQL against it over the smallest tables."""

from __future__ import annotations

import os

import pytest
from provena.llm import queries

from tests.test_queries import TABLES, con, plain

assert con  # the fixture of the tables as views


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):  # noqa: F811
    df, want = queries.QUERIES[name](spark, TABLES), con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    rows = [tuple(plain(x) for x in r) for r in want.fetchall()]
    assert sorted(rows, key=str) == sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
