"""Rows of a query and of its SQL twin in one comparable form."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v) + 0.0:.10g}"
    return str(v)


def rows(p):
    names = sorted(p.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in p[names].astype(object).itertuples(index=False))
