"""Every registered document query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from foliant import block_queries, page_queries  # noqa: F401 - they register their queries
from foliant.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.5f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    rel = db.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(plain(v) for v in r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    assert got == want
