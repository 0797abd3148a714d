"""Every registered query of the corpus engine against its DuckDB SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from lexatlas.plans import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows(names: list[str], values) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(v[i]) for i in order]) for v in values)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def distinct() -> list[str]:
    """Names of queries, one for each pair of function and SQL."""
    found: dict = {}
    for name in sorted(QUERIES):
        found.setdefault((QUERIES[name], ORACLE.get(name)), name)
    return sorted(found.values())


@pytest.mark.parametrize("name", distinct())
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE:
        want = duck.execute(ORACLE[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())
