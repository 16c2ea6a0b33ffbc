"""Every registered query of the library's own operators against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from evidentia import plans


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NA or v != v:
        return None
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, r)) for r in df[names].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = plans.QUERIES[name](spark, sf_dir).toPandas()
    if name in plans.SQL:
        assert rows_of(found) == rows_of(duck.execute(plans.SQL[name]).df())


def test_twice_is_the_same(spark, sf_dir):
    a, b = (rows_of(plans.QUERIES["agg_story_status"](spark, sf_dir).toPandas()) for _ in range(2))
    assert a == b
