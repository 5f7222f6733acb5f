"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import pandas as pd
import pytest

import __spark_entry__
from cytolake.plans.catalogue import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(x):
    if pd.isna(x):
        return None
    return round(float(x), 8) if isinstance(x, float) else x


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in frame.itertuples(index=False, name=None)), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got) or name == "expression_heatmap"
        return
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(abs(u - v) < 3e-8 if isinstance(u, float) and isinstance(v, float) else u == v for u, v in zip(x, y)), (x, y)


def test_entry(spark):
    assert FLAGSHIP in __spark_entry__.queries() and __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
