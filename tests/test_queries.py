"""Every registered query of the library runs, and equals its SQL in DuckDB where it has one."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from corpusloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(([plain(v) for v in r] for r in df[cols].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows(found) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
