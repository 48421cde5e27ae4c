"""Every query with SQL against DuckDB on the same tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from gridmere.plans.catalogue import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str, bytes)):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "replace") and getattr(v, "tzinfo", None):
        return str(v.replace(tzinfo=None))
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    got = rows(df.columns, df.collect())
    assert got
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        want = rows(names, result.fetchall())
        assert len(got) == len(want)
        differ = [(g, w) for g, w in zip(got, want) if g != w]
        assert not differ, differ[:3]
