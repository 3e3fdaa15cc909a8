"""Compare a Spark query with its SQL in DuckDB: columns by name, rows as a multiset."""

import glob
import os
from collections import Counter

import duckdb


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    return con


def rows(cols, data):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in data)


def same(df, con, sql):
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    want, have = rows(cols, got.fetchall()), rows(df.columns, map(tuple, df.collect()))
    assert want == have, (list((want - have).items())[:5], list((have - want).items())[:5])
