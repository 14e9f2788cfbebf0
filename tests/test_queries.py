"""Every registered query outside the optional subpackage: equal to its SQL, or of a stable schema."""

import importlib
import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clients".split()
MODULES = [importlib.import_module(f"verigrain.plans.{m}") for m in entry.MODULES]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return v.isoformat().replace("+00:00", "") if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert columns and len(set(columns)) == len(columns) and rows
        return
    sql = duck.sql(ORACLES[name])
    assert sorted(sql.columns) == columns
    order = [sql.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in sql.fetchall())


def test_entry_and_registry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
