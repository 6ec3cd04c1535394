"""Compare a query's rows with those of its SQL in DuckDB, regardless of order."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def compare(con, df, sql):
    names = sorted(df.columns)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    want = sorted([plain(r[i]) for i in at] for r in found.fetchall())
    got = sorted([plain(r[n]) for n in names] for r in df.collect())
    assert got == want
