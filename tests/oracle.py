"""Compare a query with its SQL on the driver's tables: column names, row count, values in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")


def connect(d=DATA):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{d}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    return str(v)


def compare(spark, con, query, sql, d=DATA):
    df = query(spark, d)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    order = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [rel.columns.index(c) for c in order]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert len(mine) == len(want), (len(mine), len(want))
    bad = [(a, b) for a, b in zip(mine, want, strict=True) if a != b]
    assert not bad, (order, bad[:3])
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
    types = {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    off = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t, t) != types[c]]
    assert not off, off
    return len(mine)


