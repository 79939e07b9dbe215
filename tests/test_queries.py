"""Every base query runs, and gives the rows of its SQL on the supplied tables."""

import math
import os
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers the base queries
from tidewell.plans import catalog

SF = os.environ.get("TIDEWELL_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, Decimal):
        x = int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{round(x, 5) + 0.0:.5f}"
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return str([_plain(y) for y in x])
    return str(x)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = _rows(df.columns, df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got[0]
        return
    cur = duck.execute(sql)
    want = _rows([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
