"""Compares a registered query with its SQL, or rows with rows, order left aside."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connection(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in sorted(os.listdir(d)):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{d}/{t}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v: object) -> str:
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "-"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, int | float) or type(v).__name__.startswith(("int", "float")):
            return repr(float(v))
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
