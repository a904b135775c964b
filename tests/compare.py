"""Holds a Spark result against DuckDB's on the same parquet files."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in data)


def differences(df, con, sql):
    """None if equal, else what differs."""
    relation = con.sql(sql)
    want, got = relation.fetchall(), [tuple(r) for r in df.collect()]
    if sorted(relation.columns) != sorted(df.columns):
        return f"columns {sorted(relation.columns)} {sorted(df.columns)}"
    a, b = rows(df.columns, got), rows(relation.columns, want)
    if a != b:
        gone, new = sorted(set(b) - set(a)), sorted(set(a) - set(b))
        return f"{len(b)} rows wanted, {len(a)} got; missing {gone[:3]}; unexpected {new[:3]}"
    return None
