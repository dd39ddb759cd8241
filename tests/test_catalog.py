import glob
import os

import duckdb
import pytest

from lineform.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    return sorted((tuple(f"{float(x):.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = plain(duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({sql})").fetchall())
    assert got == want
