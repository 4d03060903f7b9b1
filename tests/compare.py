"""Rows of a query against rows of its SQL."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([normal(x) for x in v])
    return repr(v)


def same(df, connection, sql):
    columns = sorted(df.columns)
    got = sorted(tuple(map(normal, r)) for r in df.select(*columns).collect())
    assert sorted(connection.sql(sql).columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(tuple(map(normal, r)) for r in connection.sql(f"select {quoted} from ({sql})").fetchall())
    assert got == want
