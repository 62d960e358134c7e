"""Each registered query of the core against its SQL, on the smallest tables; and the entry point."""

import glob
import math
import os

import pytest

from tracekit.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    key = lambda row: [(v is None, str(v)) for v in row]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    rows = sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=key)
    assert len(got) == len(rows)
    for a, b in zip(got, rows, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, float) for x in (*a, *b)) else all(x == y or isinstance(x, float) and y is not None and abs(x - y) <= 2e-5 for x, y in zip(a, b, strict=True))


def test_minima_are_apart(spark):
    rows = QUERIES["w4_local_minima"](spark, SF).orderBy("entity", "frame").collect()
    assert all(b.frame - a.frame >= 5 for a, b in zip(rows, rows[1:], strict=False) if a.entity == b.entity)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
