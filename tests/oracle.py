"""A query and its SQL side by side."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows as comparable texts, columns by name."""
    def text(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return "NULL"
        return f"{x:.6f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


def check(spark, con, query, sql: str, sf_dir: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert [x for x in zip(a, b) if x[0] != x[1]][:3] == []
