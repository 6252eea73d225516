"""Comparison of Spark results with SQL on the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(folder: str, sql: str, **frames: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        if t in frames:
            con.register(t, frames[t])
        else:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(sql).df()


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows in order, columns by name, numbers by value."""

    def cell(v):
        if v is None or isinstance(v, float) and v != v or v is pd.NA:
            return ("", None)
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return ("b", v)
        if isinstance(v, (int, float)):
            return ("n", float(v))
        return ("s", str(v))

    cols = sorted(df.columns)
    return sorted((tuple(cell(v) for v in row) for row in df[cols].itertuples(index=False, name=None)), key=repr)


def same(found: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(want.columns)
    a, b = canonical(found), canonical(want)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
