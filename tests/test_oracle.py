"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import math

import duckdb
import pytest

from veridale import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))  # the others: test_plain.py
def test_query(spark, small, duck, name):
    df = plans.QUERIES[name](spark, small)
    got = df.collect()
    res = duck.execute(plans.SQL[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, res.fetchall())
    got = rows_of(df.columns, got)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
