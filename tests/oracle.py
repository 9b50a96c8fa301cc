"""Comparison of a query with its SQL in DuckDB, order and column order aside."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        if isinstance(x, (int, float, np.integer, np.floating)):
            return float(x)
        return str(x)

    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


def same(query, sql: str, spark, folder: str) -> None:
    got, wanted = query(spark, folder).toPandas(), connection(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert len(got) > 0
    assert rows(got) == rows(wanted)
