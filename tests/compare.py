"""Comparison of a query's rows with its DuckDB twin's, as the driver does it."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v != v:
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 9) + 0.0 if isinstance(v, float) else v

    rows = [tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)]
    return names, sorted(rows, key=repr)
