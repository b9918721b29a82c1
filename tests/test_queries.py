"""Every registered query of the library against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from keyloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}{'/*.parquet' if os.path.isdir(f'{SF}/{f}') else ''}'")
    return con


def plain(x):
    if isinstance(x, bytearray):
        return bytes(x)
    if isinstance(x, float) and math.isfinite(x):
        return round(x, 9) + 0.0
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, expected = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert got == expected
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    types = dict(df.dtypes)
    assert {c: kinds.get(str(t)) for c, t in zip(rel.columns, rel.types, strict=True)} == {c: types[c] for c in rel.columns}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
