"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    return sorted(columns), sorted((tuple(cell(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries().keys()))
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in entry.oracle_sql():
        assert got[1]
        return
    result = con.execute(entry.oracle_sql()[name])
    assert got == rows([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
