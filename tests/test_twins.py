"""Queries against their DuckDB twins on rows that the smallest tables lack."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tessera.catalog import QUERIES, SQL


def twins(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        path = os.path.join(folder, f"{t}.parquet")
        pq.write_table(rows, path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    relation = con.execute(SQL[name])
    columns = [c[0] for c in relation.description]
    want = sorted(map(repr, relation.fetchall()))
    return sorted(repr(tuple(r)) for r in QUERIES[name](spark, str(folder)).select(*columns).collect()), want


def test_content_digest_has_two_levels_at_every_size(spark, tmp_path):
    """More than 64 blocks in a language, and languages of less than a block beside it."""
    n = 64 * 64 + 200
    rows = pa.table({"doc_id": list(range(n)), "text": [None if i % 97 == 0 else f"text {i}" for i in range(n)], "lang": ["fr" if i % 500 == 1 else "de" if i < 70 else "en" for i in range(n)]})
    got, want = twins(spark, tmp_path, "a22_content_digest", documents=rows)
    assert len(want) == 3 and got == want


def test_formatting_at_halves_and_nulls(spark, tmp_path):
    """Prices whose percentage lies half way between two decimals or just beside it, and nulls."""
    prices = [float(1000 * i + 500) for i in range(700)] + [1000 * i + 500 + d for i in range(700) for d in (-0.01, 0.01, 1e-9, -1e-9)] + [None, 0.0, -500.0, -1500.0]
    keys = [*range(len(prices) - 1), None]
    got, want = twins(spark, tmp_path, "f28_formatting", orders=pa.table({"o_orderkey": pa.array(keys, pa.int64()), "o_totalprice": pa.array(prices, pa.float64())}))
    assert got == want
