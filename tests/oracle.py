"""Compare a DataFrame with SQL on the same tables."""

from __future__ import annotations

import os
from functools import lru_cache

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@lru_cache
def connection(sf: str):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def cell(x):
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    return repr(x) if x is None or not isinstance(x, list) else repr([cell(y) for y in x])


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def assert_same(df, sql: str, sf: str) -> None:
    rel = connection(sf).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
