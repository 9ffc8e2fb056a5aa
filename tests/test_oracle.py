"""Every query with SQL gives DuckDB's rows on the smallest tables; every other one runs."""

import numbers

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from plumbline.plans import catalog, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str([None if pd.isna(v) is True else float(v) if isinstance(v, numbers.Number) else v for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if sql := oracle.oracle_sql().get(name):
        assert rows(got) == rows(db.sql(sql).df())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
