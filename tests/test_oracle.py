"""Every registered query against its DuckDB statement on the smallest tables."""

import decimal
import math

import duckdb
import pandas as pd
import pytest

from tarnwell import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([plain(i) for i in x])
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, pd.Timestamp):
        return x.isoformat()
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 5)
    return x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, duck, name):
    found = catalog.queries()[name](spark, small).toPandas()
    if name not in catalog.oracle_sql():
        assert len(found.columns)
        return
    wanted = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
