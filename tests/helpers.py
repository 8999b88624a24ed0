"""Comparing Spark results with DuckDB's."""

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def bag(frame: pd.DataFrame) -> Counter:
    names = sorted(frame.columns)
    plain = lambda x: tuple(x) if hasattr(x, "__len__") and not isinstance(x, str) else None if pd.isna(x) else x
    return Counter(tuple(plain(x) for x in row) for row in frame[names].astype(object).itertuples(index=False))


def duck(sql: str, data: str = DATA, **frames: pd.DataFrame) -> pd.DataFrame:
    connection = duckdb.connect()
    for file in Path(data).glob("*.parquet"):
        if file.stem not in frames:
            connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}{'/*.parquet' if file.is_dir() else ''}'")
    for name, frame in frames.items():
        connection.register(name, frame)
    return connection.execute(sql).df()


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    x, y = bag(a), bag(b)
    assert x == y, (list((x - y).items())[:3], list((y - x).items())[:3])
