"""Registered queries against the SQL that states the same results, on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusweave.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else int(v) if float(v).is_integer() else round(float(v), 6)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def compare(spark, name, module):
    db = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    want = db.execute(module.SQL[name]).df()
    got = module.QUERIES[name](spark, FOLDER).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, name, catalogue)


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
