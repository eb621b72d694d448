"""Every query that has a DuckDB twin gives the twin's rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "None" if math.isnan(v) else f"{v:.6f}"
    if hasattr(v, "as_tuple"):
        return f"{float(v):.6f}"
    return str(v)[:19] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_duckdb(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    relation = duck.execute(SQL[name])
    columns = [c[0] for c in relation.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in relation.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
