"""Runs DuckDB SQL over a folder of Parquet tables and compares it with a DataFrame, rows in any order."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def canon(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(int(v)) if v == int(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(folder + "/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return con


def same(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted(tuple(canon(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    theirs = sorted(tuple(canon(r[i]) for i in order) for r in cursor.fetchall())
    assert sorted(names) == columns
    assert ours == theirs
