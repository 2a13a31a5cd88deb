"""Holds rows of Spark against rows of DuckDB, whatever the order of rows and columns."""

from __future__ import annotations

import math
from pathlib import Path


def connection(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 7) + 0.0
    return v


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(cell(r[i]) for i in order) for r in values), key=repr)


def assert_same(df, c, sql: str) -> None:
    found = c.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())
