"""Each query against its SQL in DuckDB, values and columns."""

import math
from decimal import Decimal

import duckdb
import pytest

from foldlake.plans import catalog_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in values), key=repr)


def compare(spark, duck, query, sql, sf=SF):
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b


@pytest.mark.parametrize("name", sorted(catalog_queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, catalog_queries.queries()[name], catalog_queries.oracle_sql()[name])
