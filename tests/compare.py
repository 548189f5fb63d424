"""Order-insensitive comparison of a Spark result with DuckDB SQL on the same tables."""

import os

import duckdb
import pandas as pd


def duck(sql, folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    return con.execute(sql).df()


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)

    def text(v):
        if hasattr(v, "tolist") and not hasattr(v, "item"):
            return str([text(x) for x in v.tolist()])
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "none"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(map(tuple, df.map(text).values.tolist()))


def assert_same(result, sql, folder):
    a, b = result.toPandas(), duck(sql, folder)
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
