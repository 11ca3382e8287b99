"""Every query without training data against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from garimpo.plans import registry

SLOW = {"o73_crawl_waves"}


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    clean = lambda v: "NULL" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else round(v, 6) if isinstance(v, float) else v
    return sorted(str(tuple(clean(v) for v in r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLES:
        assert len(got.columns)
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
