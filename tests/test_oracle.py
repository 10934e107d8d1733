"""Every query with SQL against DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from sentinela.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    return v


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("customer", "orders", "events", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(Q.ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = sorted((tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    df = Q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    got = sorted((tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_rows_only(spark, name):
    assert Q.QUERIES[name](spark, SF).count() >= 0
