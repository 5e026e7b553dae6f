"""Rows of a Spark result and of SQL in DuckDB, in a form that compares."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value != value:
        return "null"
    return repr(value if not hasattr(value, "__len__") or isinstance(value, str) else list(value))


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False))
