"""Every catalogue query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from sluice.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canon(rows, order):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    cur = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    mine = canon(df.collect(), [df.columns.index(c) for c in sorted(names)])
    assert mine == canon(cur.fetchall(), [names.index(c) for c in sorted(names)])
