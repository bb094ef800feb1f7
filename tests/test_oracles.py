"""Every registered query of the engine proper against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from framewise import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, data, name):
    found = registry.QUERIES[name](spark, data)
    told = duck.sql(registry.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(told.columns)
    kinds = dict(zip(told.columns, map(str, told.types), strict=True))
    assert {c: KINDS.get(k, k) for c, k in found.dtypes} == kinds
    at = [told.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in found.collect()) == sorted([plain(r[i]) for i in at] for r in told.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
