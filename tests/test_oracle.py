"""Every registered query with a SQL twin gives the same rows in DuckDB; the others run."""

import glob
import math
import os

import duckdb
import pytest

from mnemospark.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def _plain(v):
    v = v.item() if hasattr(v, "item") else v
    return (None if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    names = sorted(df.columns)
    cur = con.execute(registry.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    want = [tuple(_plain(r[have.index(n)]) for n in names) for r in cur.fetchall()]
    got = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
