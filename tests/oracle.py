"""Runs a query beside its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import decimal
import os

import duckdb
import pandas as pd

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    if isinstance(x, dict):
        return tuple((k, _plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 6)
    if isinstance(x, pd.Timestamp):
        return x.isoformat()
    return x


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_plain(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> tuple[list[tuple], list[tuple]]:
    """(rows of Spark, rows of DuckDB), with the same columns in the same order."""
    got = query(spark, sf_dir)
    want = duck(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (got.columns, list(want.columns))
    return rows_of(got.toPandas()), rows_of(want)
