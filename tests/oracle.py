"""Comparing a query with its SQL twin in DuckDB."""

import os
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata/sf0.001")


def connect(data: Path = DATA):
    con = duckdb.connect()
    for p in sorted(data.glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, float | int) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(plain(v) for v in r)) for r in df.itertuples(index=False, name=None))
