"""Compares a query with its SQL twin, columns sorted by name, rows in any order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(df, sql, sf_dir):
    got, want = df.toPandas(), connect(sf_dir).execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1.5e-6)
