"""Comparison of a Spark result with DuckDB's over the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or pd.isna(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 9)
    return v


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def tables(folder: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return c
