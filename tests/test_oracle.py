"""Every registered query of the index against DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from quarrydex.plans.oracle import ORACLE_SQL
from quarrydex.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL) and len(QUERIES) == 56


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    cursor = duck.execute(ORACLE_SQL[name])
    names, kinds = zip(*[(c[0], str(c[1])) for c in cursor.description])
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(df.columns) == sorted(names)
    assert {c: TYPES[k] for c, k in df.dtypes} == dict(zip(names, kinds))
    want = sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    got = sorted(tuple(plain(r[names[i]]) for i in order) for r in df.collect())
    assert got == want
