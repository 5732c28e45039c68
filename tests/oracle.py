"""Spark results against DuckDB on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def same(df, sql: str, folder: str) -> None:
    names = sorted(df.columns)
    result = connect(folder).execute(sql)
    own = [d[0] for d in result.description]
    assert sorted(own) == names
    theirs = sorted(repr([row[own.index(n)] for n in names]) for row in result.fetchall())
    ours = sorted(repr([row[n] for n in names]) for row in df.collect())
    assert ours == theirs
