"""Every query with SQL gives the same rows as DuckDB."""

import math

import duckdb
import pytest

from corpuslens.plans.query_set import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    got = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"vector_ann_topk", "segmented_postings"}  # approximate, and a best path
