"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def rows(df) -> list[tuple]:
    names = sorted(df.columns)
    out = []
    for r in df[names].itertuples(index=False):
        row = []
        for x in r:
            if x is None or x is pd.NA or x != x:
                row.append(None)
            elif isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f":
                row.append(round(float(x), 6))
            else:
                row.append(x.item() if hasattr(x, "item") else x)
        out.append(tuple(str(v) if not isinstance(v, (int, float, str, bool, type(None))) else v for v in row))
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


def both(spark, sf: str, query, sql: str) -> tuple[list[tuple], list[tuple]]:
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = query(spark, sf).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    return rows(got), rows(want)
