"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from quarryline.plans.registry import FLAGSHIP, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, int | float) or hasattr(v, "item") and not hasattr(v, "__len__") and isinstance(v.item(), int | float):
        x = float(v)
        return f"{x:.5f}" if math.isfinite(x) else str(x)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(con.sql(ORACLES[name]).df())
    else:
        assert len(got.columns)


def test_flagship_has_rows():
    assert FLAGSHIP in QUERIES and FLAGSHIP in ORACLES
