"""Every registered query with SQL gives the rows that DuckDB gives; every other one gives rows."""

import math

import duckdb
import pytest

from tarnfell.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    got = df.collect()
    if name not in ORACLE_SQL:
        assert got
        return
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in got) == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())
