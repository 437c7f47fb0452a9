"""Every query with SQL gives DuckDB's rows; the others give rows."""

import math

import duckdb
import pytest

import __spark_entry__
from caseforge.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROWS_ONLY = [n for n in QUERIES if n not in ORACLES]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.5f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def listed(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = duck.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert listed([tuple(r) for r in df.collect()], df.columns) == listed(got.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
