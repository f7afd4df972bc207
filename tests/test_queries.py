"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import decimal
import math
import os

import duckdb
import numpy as np
import pytest

from corvane.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def norm(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(norm, v))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in ORACLES:
        res = con.execute(ORACLES[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == columns
        want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in res.fetchall()), key=repr)
        assert got == want
