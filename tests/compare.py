"""Runs a query in Spark and its SQL in DuckDB and compares names, rows and values."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def check(spark, con, name: str, query, sql: str, sf_dir: str = SF) -> None:
    df = query(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    assert len(got) == len(want), (name, len(got), len(want))
    different = [(a, b) for a, b in zip(got, want) if a != b]
    assert not different, (name, len(different), different[:3])
    kinds = {(type(x).__name__, type(y).__name__) for a, b in zip(got, want) for x, y in zip(a, b) if x is not None and y is not None}
    assert all(x == y for x, y in kinds), (name, kinds)
