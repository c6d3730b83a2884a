"""Every registered query with SQL gives the rows of that SQL; the others run."""

from __future__ import annotations

import math

import duckdb
import pytest

from lodestar.oracle import oracle_sql
from lodestar.queries import queries

TABLES = "documents pages benchmark labels conversations".split()
NAMES = sorted(queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return base


def normal(rows):
    key = lambda v: (v is None, str(type(v) is str), v if v is not None else 0)
    shaped = [tuple(round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows]
    return sorted(shaped, key=lambda r: [key(v) for v in r])


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, sf_dir, duck, name):
    got = queries()[name](spark, sf_dir)
    sql = oracle_sql().get(name)
    if sql is None:
        assert got.columns and got.count() > 0
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert normal(map(tuple, got.select(*columns).collect())) == normal(want.fetchall())


def test_names_of_sql_are_queries():
    assert set(oracle_sql()) <= set(NAMES)
    assert len(NAMES) > 100
