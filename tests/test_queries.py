"""Every query with SQL against another engine on the smallest tables; the rest give rows."""

import math

import duckdb
import pytest

from plansheet.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

def key(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(key, r)) for r in df.select(*columns).collect())
    if name not in catalog.ORACLE_SQL:
        return
    sql = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    assert got == sorted(tuple(map(key, r)) for r in duck.sql(f"select {', '.join(columns)} from ({catalog.ORACLE_SQL[name]})").fetchall())
