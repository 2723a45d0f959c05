"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lamplight.plans import catalogue, upkeep  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.8g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.SQL:
        return
    r = con.execute(catalogue.SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    mine = sorted(tuple(norm(row[c]) for c in sorted(cols)) for row in rows)
    theirs = sorted(tuple(norm(row[cols.index(c)]) for c in sorted(cols)) for row in r.fetchall())
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__

    assert set(catalogue.SQL) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
