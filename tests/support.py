"""Helpers of the tests: comparing a Spark result with SQL over the same tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder: str = DATA):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return f"{float(v) + 0.0:.9g}"
    if isinstance(v, (int, np.integer)):
        return f"{int(v):.9g}" if abs(int(v)) < 10**8 else str(int(v))
    return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False, name=None))
