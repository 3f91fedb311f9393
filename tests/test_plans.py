"""Every query with SQL agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lamella import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, name):
    df = plans.queries()[name](spark, DATA)
    got = df.collect()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({sql})").fetchall()
    assert plain([[r[c] for c in cols] for r in got]) == plain(want)
