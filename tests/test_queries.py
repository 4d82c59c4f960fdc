"""Every query of the fact engine against its SQL on the smallest tables."""

import decimal
import os

import pytest

from factloom import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def _plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    return round(v, 4) + 0.0 if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    rows, sql = df.collect(), catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    want = [tuple(_plain(r[names.index(c)]) for c in order) for r in cur.fetchall()]
    assert sorted([tuple(_plain(r[c]) for c in order) for r in rows], key=str) == sorted(want, key=str)


def test_entry_needs_no_training_data_operators():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
