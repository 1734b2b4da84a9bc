"""Each query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from gondola.plans import marts, validation  # noqa: F401  validation imports all other plans

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(rows):
    one = lambda v: ("null",) if v is None or (isinstance(v, float) and math.isnan(v)) else (type(v).__name__, round(v, 9) + 0.0 if isinstance(v, float) else v)
    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(marts.QUERIES))
def test_query(spark, duck, name):
    got = marts.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = canon(got.select(*columns).collect())
    assert rows
    if name in marts.ORACLE:
        want = duck.execute(f"select {', '.join(columns)} from ({marts.ORACLE[name]})").fetchall()
        assert rows == canon(want)
