import os

import duckdb
import pandas as pd
import pytest

from prosemeter import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else (f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)))
    return df.fillna("~").sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_against_sql(spark, data, duck, name):
    got = plans.queries()[name](spark, data).toPandas()
    assert len(got)
    if name in plans.sql():
        want = duck.execute(plans.sql()[name]).df()
        a, b = tidy(got), tidy(want)
        assert list(a.columns) == list(b.columns)
        assert a.equals(b)


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
