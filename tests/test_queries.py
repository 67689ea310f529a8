"""Every query against its SQL in DuckDB at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from loftline.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def normal(p):
    p = p[sorted(p.columns)].copy()
    for c in p.columns:
        if pd.api.types.is_numeric_dtype(p[c]) and not pd.api.types.is_bool_dtype(p[c]):
            p[c] = p[c].astype("float64") + 0.0
    return p.astype(str).replace({"None": "nan", "<NA>": "nan", "NaN": "nan"}).sort_values(list(p.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, oracle, name):
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), oracle.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0
