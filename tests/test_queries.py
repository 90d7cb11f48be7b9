"""Every registered query of the reference's operators against its SQL over the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from provena.plans import evidence_queries, relational_queries, retrieval_queries, scoring_queries, stream_queries

TABLES = os.environ.get("PROVENA_TEST_TABLES", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = (retrieval_queries, relational_queries, scoring_queries, stream_queries, evidence_queries)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v if v is None or isinstance(v, int | bool) else str(v)


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    found.execute("set timezone = 'UTC'")
    for t in NAMES:
        found.execute(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    return found


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df, want = QUERIES[name](spark, TABLES), con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    rows = [tuple(plain(x) for x in r) for r in want.fetchall()]
    assert sorted(rows, key=str) == sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
