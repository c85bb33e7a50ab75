"""Rows of both engines in one form, so that they can be compared whatever their order."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd

from tidemark.tables import NAMES


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for n in NAMES:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer, float, np.floating, Decimal)):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return datetime.datetime(x.year, x.month, x.day).isoformat()
    if isinstance(x, (list, np.ndarray)):
        return tuple(map(plain, x))
    return x


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)
