"""Run a query and its SQL on the same tables and compare rows as multisets."""

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    def fix(v):
        if v is None or pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "__index__") else str(v)

    return sorted(str([fix(v) for v in r]) for r in frame.astype(object).itertuples(index=False))


def expected(sql: str, folder: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con.sql(sql).df()
