"""Compares a query with its SQL in DuckDB."""

import os

import duckdb
import pandas as pd


def value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.item() if hasattr(v, "item") else v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(value, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


def expected(sql, folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"create view {f.partition('.')[0]} as select * from '{folder}/{f}'")
    return rows(c.sql(sql).df())


def assert_same(df, sql, folder):
    assert rows(df.toPandas()) == expected(sql, folder)
