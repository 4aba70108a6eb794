"""Side-by-side comparison of a query with its SQL, as multisets of normalised rows."""

import glob
import os
from collections import Counter

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def value(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, pd.Timestamp):
        return str(x.tz_convert("UTC").tz_localize(None) if x.tzinfo else x)
    if isinstance(x, str) or type(x).__name__ in ("bool", "bool_"):
        return str(x)
    return repr(round(float(x), 6))


def rows(df):
    df = df[sorted(df.columns)]
    return Counter(tuple(map(value, r)) for r in df.itertuples(index=False))
