"""Compares a query with its DuckDB SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def rows_of(columns, rows):
    return sorted(tuple(plain(r[c]) for c in columns) for r in rows)


def check(df, connection, sql):
    columns = sorted(df.columns)
    got = rows_of(columns, df.collect())
    rel = connection.sql(sql)
    assert sorted(rel.columns) == columns
    want = rows_of(columns, [dict(zip(rel.columns, r)) for r in rel.fetchall()])
    assert len(got) == len(want)
    assert got == want
    return len(got)
