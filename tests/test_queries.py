"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from gneiss.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: ("nan" if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else str(v) if type(v).__name__ in ("date", "datetime", "Decimal") else v
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in registry.ORACLES:
        assert len(got) > 0
        return
    want = sql.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(list(want.columns), want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
